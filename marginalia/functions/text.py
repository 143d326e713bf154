"""Column expressions over text: normalisation for matching, labels, headings, sentences, slugs.

Each is a plain built-in expression, so it stays in generated code and can be pushed into any projection.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic marks and the ASCII mark each folds to.
FOLD_FROM = "‘’‚‛“”„‟–—―−\u00a0\u202f"
FOLD_TO = "''''\"\"\"\"----  "
#: Transliteration codes (Manuel de Codage) with one sign each, and the two codes that stand for two code points.
MDC_FROM = "AaHxXSTDqI@#^*+©!%&_¡¢¤¥¦§"
MDC_TO = "ꜣꜥḥḫẖšṯḏḳꞼḤḪŠṮḎḎHSTDḤḪSŠTṮ"
MDC_TWO = {"$": "H\u0331", "£": "H\u0331"}
#: Irregular plurals.
IRREGULAR = {"wives": "wife", "lives": "life", "children": "child", "women": "woman", "men": "man", "feet": "foot", "teeth": "tooth"}
#: Section titles that aren't prose, and how reference sections start.
NOT_PROSE = ("FRONT MATTER", "ACKNOWLEDGEMENTS", "TABLE OF CONTENTS", "TABLES", "CHRONOLOGY ABBREVIATIONS", "ABBREVIATIONS", "BIBLIOGRAPHY", "BIBLIOGRAPHY FOR THE TEXT", "INDICES", "PART ONE", "PART TWO", "PART THREE")
REFERENCE_STARTS = ("TABLE ", "INDEX ", "FIGURE", "ACCESSORIES")
CLOSERS = ".!?\"'”’)]"
#: White space as the rules mean it: ASCII, the separators U+001C to U+001F, NEL and all of Unicode's.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


#: Fixed patterns of the form that quotes are matched in: private-use signs, note marks, digits glued to a word.
PRIVATE, NOTE_MARK = r"[\x{E000}-\x{F8FF}]", r"\[\^\d+\]"
GLUED_DIGITS = r"""(?=\d)(?<=[A-Za-z])\d{1,2}(?=[\s\x1c-\x1f.,;:!?’'")\]]|\z)"""


def normalized(text: Column) -> Column:
    """Text as quotes are matched in it. Null is empty. To be applied once: nested note markers aren't stable under it."""
    t = F.coalesce(text, F.lit(""))
    folded = F.replace(F.translate(F.regexp_replace(t, PRIVATE, " "), FOLD_FROM, FOLD_TO), F.lit("…"), F.lit("..."))
    t = F.when(F.octet_length(t) == F.length(t), t).otherwise(folded)  # ASCII has nothing to fold
    t = F.regexp_replace(F.regexp_replace(t, NOTE_MARK, ""), GLUED_DIGITS, "")
    return F.trim(F.regexp_replace(t, BLANK, " "))


def is_anchored(quote: Column, stream: Column) -> Column:
    """Both normalised already. An empty quote is anchored anywhere."""
    return F.contains(F.coalesce(stream, F.lit("")), F.coalesce(quote, F.lit("")))


def transliterated(text: Column) -> Column:
    """All codes at once: what one replacement makes isn't replaced again."""
    held = dict(zip(MDC_TWO, ""))
    out = F.translate(text, MDC_FROM + "".join(held), MDC_TO + "".join(held.values()))
    for code, mark in held.items():
        out = F.replace(out, F.lit(mark), F.lit(MDC_TWO[code]))
    return out


def by_font(text: Column, font: Column) -> Column:
    return F.when(F.contains(F.coalesce(font, F.lit("")), F.lit("Transliteration")), transliterated(text)).otherwise(text)


#: Fixed pattern: a word with one run of digits.
ONE_NUMBER = r"^(\D*)(\d+)(\D*)$"


def footnote_marker(text: Column, size: Column, median: Column) -> Column:
    """The one run of digits of a small word becomes a note marker."""
    return F.when((size < 0.75 * median) & text.rlike(ONE_NUMBER), F.regexp_replace(text, ONE_NUMBER, "$1[^$2]$3")).otherwise(text)


def is_page_label(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\.+|\.+$", "")
    return F.coalesce(bare.rlike(r"^\d+$") | F.lower(bare).rlike("^[ivxlcdm]+$"), F.lit(False))


def looks_like_header(text: Column) -> Column:
    """At least four letters, at least 80 per cent of them upper-case."""
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.coalesce((letters >= 4) & (upper * 5 >= letters * 4), F.lit(False))


def despaced(text: Column) -> Column:
    """A lone letter joins the token after it; both are then done with, so the fold goes through the tokens in order."""
    tokens = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(cid:\d+\)", " "), BLANK), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("lone"))

    def step(acc: Column, token: Column) -> Column:
        held = acc["lone"] != ""
        alone = (F.length(token) == 1) & token.rlike(r"^\p{L}$")
        return F.when(held, F.struct(F.array_append(acc["done"], F.concat(acc["lone"], token)).alias("done"), F.lit("").alias("lone"))).when(alone, F.struct(acc["done"].alias("done"), token.alias("lone"))).otherwise(F.struct(F.array_append(acc["done"], token).alias("done"), F.lit("").alias("lone")))

    return F.aggregate(tokens, start, step, lambda acc: F.array_join(F.when(acc["lone"] != "", F.array_append(acc["done"], acc["lone"])).otherwise(acc["done"]), " "))


def section_key(top_line: Column) -> Column:
    t = F.trim(F.upper(despaced(top_line)))
    number = F.regexp_extract(t, r"^CHAPTER\s+(\d+|[IVXLCDM]+)\b", 1)
    return F.when(number != "", F.concat(F.lit("CHAPTER "), number)).otherwise(t)


def is_reference(title: Column) -> Column:
    t = F.upper(title)
    out = F.lit(False)
    for start in REFERENCE_STARTS:
        out = out | t.startswith(start)
    return out


def is_prose(title: Column) -> Column:
    t = F.trim(F.upper(title))
    listed = t.startswith("TABLE ") | t.startswith("INDEX ") | t.startswith("FIGURE")
    return ~listed & ~t.isin(*NOT_PROSE)


def ends_open(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + r"\z", "")
    return (t != "") & ~F.contains(F.lit(CLOSERS), F.right(t, F.lit(1)))


#: Fixed patterns: the first sentence end of a text, and where a normalised stream is cut into sentences.
FIRST_SENTENCE = r"""(?s)\A(.*?[.!?]["'”’)\]]*(?:\[\^\d+\])?)(?=\s|\z)"""
SENTENCE_CUT = r"""(?<=[.!?]) (?=[A-Z'"(])"""


def completion(body: Column, most: int = 400) -> Column:
    """The head of a text up to its first sentence end, or `most` characters where that comes sooner."""
    head = F.regexp_replace(F.coalesce(body, F.lit("")), r"\A" + BLANK, "")
    first = F.regexp_extract(head, FIRST_SENTENCE, 1)
    return F.trim(F.when((first != "") & (F.length(first) <= most), first).otherwise(F.left(head, F.lit(most))))


def sentences(norm: Column) -> Column:
    """A normalised stream cut after .!? before a capital, quote or bracket."""
    return F.split(norm, SENTENCE_CUT)


def singular(word: Column) -> Column:
    """Crude singular of a lower-case word."""
    n = F.length(word)
    known = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    es = word.rlike("(ses|xes|zes|ches|shes)$")
    rest = F.when((n <= 3) | word.endswith("ss"), word).when(word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when(es, F.left(word, n - 2)).when(word.endswith("s"), F.left(word, n - 1)).otherwise(word)
    return F.coalesce(known[word], rest)


def term_key(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda t: t != "")
    return F.array_join(F.transform(words, singular), " ")


@F.pandas_udf(StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Compatibility forms taken apart and everything beyond ASCII left out; there is no built-in function for it."""
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(text: Column, prefix: str = "t-") -> Column:
    """Accents folded, lower case, hyphens between runs of letters and digits."""
    return ascii_slug(unaccented(text), prefix)


def ascii_slug(text: Column, prefix: str = "t-") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


@lru_cache(maxsize=1)
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Full case folding by the language's own rule: characters that become one other, and those that become several."""
    changed = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """Full case folding, so that ß meets ss: one translation, and replacements for texts that hold a character which becomes
    several."""
    one, many = foldings()
    simple = F.translate(text, "".join(one), "".join(one.values()))
    whole = simple
    for c, f in many.items():
        whole = F.replace(whole, F.lit(c), F.lit(f))
    return F.when(simple.rlike(f"[{''.join(many)}]"), whole).otherwise(simple)


def normalized_passage(text: Column) -> Column:
    """Locator form: white space collapsed, case folded."""
    return folded(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")))


#: Fixed patterns: a citation (linked or bare), a run of citations within a line, the heading that the sources stand under.
CITATION = r"\[s-[0-9a-z-]+\](?:\(#[^)\n]*\))?"
CITATION_RUN = r"\[s-[^\]\n]*\](?:[ \t,]*\[s-[^\]\n]*\])*"
STATEMENT_ID = "s-[0-9a-z-]+"
SOURCES = r"(?s)\n+(?:-{3,}\n+)?#{2,4} +Notes & Sources\b.*\z"


#: Fixed patterns, in order: what goes from a study text for reading, and what is left in its place.
READING = (
    (SOURCES, ""),
    (rf"[ \t]*{CITATION}(?:[ \t,]*{CITATION})*", ""),
    (r"[ \t]+([.,;:!?)])", "$1"),
    (r"\(\s*\)", ""),
    (r"(?<=\S) {2,}(?=\S)", " "),
    (r"\s+\z", ""),
)


def without_citations(text: Column) -> Column:
    """A study text for reading, without sources and citations and what these leave behind, ending in one line feed."""
    return F.concat(reduce(lambda t, change: F.regexp_replace(t, *change), READING, text), F.lit("\n"))


def linked_citations(text: Column, known: Column) -> Column:
    """Each run of citations as a comma-joined list: links for ids in the array `known`, bare ids for others.

    The runs are taken out in order and put back between the parts around them, so no text is scanned twice."""
    runs = F.regexp_extract_all(text, F.lit(f"({CITATION_RUN})"), 1)
    parts = F.split(text, CITATION_RUN, -1)

    def shown(run: Column) -> Column:
        ids = F.regexp_extract_all(run, F.lit(f"({STATEMENT_ID})"), 1)
        return F.array_join(F.transform(ids, lambda i: F.when(F.array_contains(known, i), F.concat(F.lit("["), i, F.lit("](#note-"), i, F.lit(")"))).otherwise(i)), ", ")

    return F.array_join(F.zip_with(parts, F.transform(runs, shown), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def generation_label(g: Column) -> Column:
    """effort@max_tokens, else effort, else model, else unknown."""
    effort, most, model = (F.nullif(g[k].cast("string"), F.lit("")) for k in ("effort", "max_tokens", "model"))
    return F.coalesce(F.when(effort.isNotNull() & most.isNotNull(), F.concat_ws("@", effort, most)), effort, model, F.lit("unknown"))


def rounded(x: Column, places: int) -> Column:
    """x rounded to so many decimal places as its exact value asks for; exact halves to even.

    x times ten to the places, rounded to a double, can be a half though x is a little more or less. What that product lost
    is told exactly (the factor is multiplied with the two halves of x's digits), and then decides."""
    by = float(10**places)
    product = x * by
    high = x * 134217729.0 - (x * 134217729.0 - x)  # 2 to the 27th, and one: the leading half of the digits
    lost = (high * by - product) + (x - high) * by
    down = F.floor(product).cast("double")
    half = product - down == 0.5
    return F.when(half & (lost > 0), down + 1).when(half & (lost < 0), down).otherwise(F.rint(product)) / by
