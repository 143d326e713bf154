"""Page layout over tables of words, characters and shapes: lines, columns, footnotes, page kinds, streams.

words: book_id, page_index, word_no, text, x0, x1, top, bottom, size (and fontname where transliteration is wanted).
Everything is keyed by page. Sequential rules (lines by their first word) run as a fold over a page's distinct heights,
which are few; the rest is windows and aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.anchor import PAGE
from marginalia.operators.boxes import doubles, items, lists, met, offsets, points_in_boxes, ragged

LINE_TOLERANCE, WORD_GAP, WORD_GAP_SHARE = 3.0, 1.2, 0.18
FOOTNOTE_SHARE, LABEL_BELOW, LOW_TEXT = 0.85, 0.92, 40


def heights(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """words counted by top and size: n, their lowest bottom, and whether one looks like a page's label. Lines and footnotes
    are told from these rows, of which a line has one or two, not from its words."""
    return words.where("top is not null").groupBy(*(keys or PAGE), F.col("top").cast("double").alias("top"), "size").agg(F.count("*").alias("n"), F.max("bottom").alias("bottom"), F.max(T.is_page_label(F.trim("text"))).alias("label"))


def height_lines(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rows (with top) and the line_top of each. A line takes what is within the tolerance of its first height, not of the last
    one: a slow drift starts a new line, which a comparison of neighbours would not."""
    keys = keys or PAGE
    rest = [c for c in rows.columns if c not in keys and c != "top"]
    top = F.array_sort(F.collect_set("top"))
    acc = F.array().cast("array<double>")

    def step(a, t):
        return F.when(F.coalesce(t - F.get(a, F.size(a) - 1) <= LINE_TOLERANCE, F.lit(False)), a).otherwise(F.array_append(a, t))

    if not rest:  # the heights alone
        return rows.groupBy(*keys).agg(top.alias("_tops")).select(*keys, F.explode(F.aggregate("_tops", acc, step)).alias("line_top"))
    known = rows.groupBy(*keys).agg(top.alias("_tops"), F.collect_list(F.struct("top", *rest)).alias("_rows")).select(*keys, "_rows", F.aggregate("_tops", acc, step).alias("_tops"))
    each = known.select(*keys, "_tops", F.explode("_rows").alias("_row"))
    return each.select(*keys, "_row.*", F.get("_tops", _up_to(F.col("_tops"), F.col("_row.top")) - 1).alias("line_top"))


def line_sizes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """From heights: line_no, line_top, line_bottom, median size (0 where none is known), words of each line, and whether it is
    a lone label."""
    keys = keys or PAGE
    found = height_lines(rows, keys).groupBy(*keys, "line_top").agg(F.max("bottom").alias("line_bottom"), F.coalesce(F.percentile(F.when(F.col("size") != 0, F.col("size")), F.lit(0.5), F.col("n")), F.lit(0.0)).alias("line_size"), F.sum("n").alias("n_words"), F.max("label").alias("label"))
    return found.withColumn("label", (F.col("n_words") == 1) & F.col("label")).withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy("line_top")))


def _up_to(sorted_: Column, x: Column) -> Column:
    """How many of the sorted values are not above x: a guess for even steps, else by halves."""
    n = F.size(sorted_)
    at = lambda i: F.get(sorted_, i)
    guess = F.coalesce(F.try_divide(x - at(F.lit(0)), at(n - 1) - at(F.lit(0))) * (n - 1) + 1e-6, F.lit(0.0))
    guess = F.when((guess >= 0) & (guess < n), guess).otherwise(0.0).cast("int")

    def halve(a, _):
        mid = F.shiftright(a["lo"] + a["hi"] + 1, 1)
        below = F.coalesce(at(mid - 1) <= x, F.lit(False))
        return F.struct(F.when(below, mid).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid - 1).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda a: a["lo"])
    return F.when((at(guess) <= x) & F.coalesce(at(guess + 1) > x, F.lit(True)), guess + 1).otherwise(found)


def lined(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """words with line_no and line_top (see height_lines). A page's lines come to its words as one row, so words that are dealt
    by page stay where they are; a word finds its line by binary search."""
    keys = keys or PAGE
    rest, page = [k for k in keys if k not in PAGE], [k for k in keys if k in PAGE] or keys
    tops = height_lines(words.where("top is not null").select(*keys, F.col("top").cast("double").alias("top")).distinct(), keys).groupBy(*keys).agg(F.array_sort(F.collect_set("line_top")).alias("_tops"))
    if rest:
        tops = tops.groupBy(*page).agg(F.collect_list(F.struct(F.struct(*rest).alias("key"), "_tops")).alias("_lines")).select(*page, F.col("_lines.key").alias("_keys"), F.col("_lines._tops").alias("_each"))
    at = words.where("top is not null").join(tops, page)
    if rest:
        at = at.withColumn("_tops", F.get("_each", F.array_position("_keys", F.struct(*rest)).cast("int") - 1))
    at = at.withColumn("_no", _up_to(F.col("_tops"), F.col("top").cast("double")))
    return at.select(*words.columns, F.col("_no").alias("line_no"), F.get("_tops", F.col("_no") - 1).alias("line_top"))


def lines(lined_words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """line_top, line_bottom, median size (0 where none is known), words and text of each line, words by x0."""
    keys = keys or PAGE
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")
    return lined_words.groupBy(*keys, "line_no", "line_top").agg(F.max("bottom").alias("line_bottom"), F.coalesce(F.median(F.when(F.col("size") != 0, F.col("size"))), F.lit(0.0)).alias("line_size"), F.count("*").alias("n_words"), F.trim(text).alias("line_text"))


def body_size(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or PAGE
    return size_medians(words.groupBy(*keys, "size").agg(F.count("*").alias("n")), keys)


def size_medians(counted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """body_size from rows of size and n, such as heights."""
    return counted.groupBy(*(keys or PAGE)).agg(F.percentile(F.when(F.col("size") != 0, F.col("size")), F.lit(0.5), F.col("n")).alias("body_size"))


def gutters(words: DataFrame, sizes: DataFrame, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """The column gutter of each page (null: one column): the middle of the first longest run of least crossings in the
    page's middle band. sizes: book_id, page_index, width, height.

    A word adds two events, where it begins and where it has ended; between events the number of words that cross is
    constant, so runs are told from as many rows as there are different places, not from every x. A third event of nothing at
    0 lets each page's levels begin there, without a union that would deal the rows anew."""
    span = words.join(sizes.select(*PAGE, "width"), PAGE).select(*PAGE, F.greatest(F.lit(0), F.col("x0").cast("int")).alias("a"), F.least(F.col("width").cast("int") + 1, F.col("x1").cast("int")).alias("b")).where("a <= b")
    events = span.select(*PAGE, F.expr("stack(3, a, 1, b + 1, -1, 0, 0) as (x, step)"))
    order = Window.partitionBy(*PAGE).orderBy("x")
    level = events.groupBy(*PAGE, "x").agg(F.sum("step").alias("step")).withColumn("n", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("x").over(order) - 1)
    level = level.join(sizes.select(*PAGE, F.expr("cast(width as int) + 1").alias("end"), (F.col("width") * lo).cast("int").alias("from"), (F.col("width") * hi).cast("int").alias("to")), PAGE)
    level = level.withColumn("until", F.least(F.coalesce("until", "end"), "end"))
    inside = (F.greatest("x", "from") <= F.least("until", "to")) & (F.col("to") > F.col("from"))
    page = Window.partitionBy(*PAGE)
    ranged = level.withColumns({"top_n": F.max("n").over(page), "least_n": F.min(F.when(inside, F.col("n"))).over(page)}).where(inside & (F.col("n") == F.col("least_n")) & (F.col("top_n") > 0) & (F.col("least_n") < 0.5 * F.col("top_n")))
    clipped = ranged.select(*PAGE, F.greatest("x", "from").alias("a"), F.least("until", "to").alias("b"))
    by_a = Window.partitionBy(*PAGE).orderBy("a")
    runs = clipped.withColumn("new", F.when(F.lag("b").over(by_a) + 1 == F.col("a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by_a.rowsBetween(Window.unboundedPreceding, 0)))
    best = runs.groupBy(*PAGE, "run").agg(F.min("a").alias("a"), (F.max("b") - F.min("a") + 1).alias("long")).groupBy(*PAGE).agg(F.max_by(F.col("a") + F.col("long") / 2, F.struct("long", -F.col("a"))).alias("gutter"))
    return sizes.select(*PAGE).join(best, PAGE, "left")


def columns(words: DataFrame, gutter: DataFrame) -> DataFrame:
    """words with column_no: 0, or 1 where the middle of the word is at or beyond the gutter."""
    return words.join(gutter, PAGE).withColumn("column_no", F.when(F.col("gutter").isNotNull() & ((F.col("x0") + F.col("x1")) / 2 >= F.col("gutter")), 1).otherwise(0)).drop("gutter")


def footnote_tops(column_words: DataFrame, sizes: DataFrame, body: DataFrame) -> DataFrame:
    """Where each column's footnotes begin (the page's height where it has none): from the bottom up, small lines, lone
    label lines skipped, up to the first other line."""
    return footnote_starts(heights(column_words, [*PAGE, "column_no"]), sizes, body)


def footnote_starts(column_heights: DataFrame, sizes: DataFrame, body: DataFrame) -> DataFrame:
    """footnote_tops from the heights of each column."""
    keys = [*PAGE, "column_no"]
    rows = line_sizes(column_heights, keys).join(body, PAGE)
    small = (F.col("line_size") != 0) & (F.col("line_size") < FOOTNOTE_SHARE * F.col("body_size"))
    from_below = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_top")))
    marked = rows.select(*keys, "line_top", from_below.alias("r"), "label", small.alias("small"))
    stop = F.min(F.when(~F.col("label") & ~F.col("small"), F.col("r"))).over(Window.partitionBy(*keys))
    found = marked.withColumn("stop", stop).groupBy(*keys).agg(F.min(F.when(~F.col("label") & F.col("small") & (F.col("stop").isNull() | (F.col("r") < F.col("stop"))), F.col("line_top"))).alias("found"))
    return found.join(sizes.select(*PAGE, "height"), PAGE).select(*keys, F.coalesce("found", F.col("height").cast("double")).alias("fn_top"))


def page_labels(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """The last label word in the page's lowest part, without dots."""
    low = words.join(sizes.select(*PAGE, "height"), PAGE).where((F.col("top") > LABEL_BELOW * F.col("height")) & T.is_page_label(F.trim("text")))
    return low.groupBy(*PAGE).agg(F.max_by(F.regexp_replace(F.trim("text"), r"^\.+|\.+$", ""), "word_no").alias("page_label"))


def top_lines(lined_words: DataFrame) -> DataFrame:
    first = lined_words.where("line_no = 1")
    return lines(first).select(*PAGE, F.col("line_text").alias("top_line"))


def header_bottoms(line_rows: DataFrame, body: DataFrame) -> DataFrame:
    """Where the body begins below a header: the middle of the first wide gap, else half a size below the first line; 0 on
    pages of fewer than two lines."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    reach = F.max("line_bottom").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = line_rows.select(*PAGE, "line_no", "line_top", F.lead("line_top").over(order).alias("next_top"), reach.alias("reach")).join(body, PAGE)
    wide = F.when(F.col("next_top") - F.col("line_top") > 1.8 * F.col("body_size"), F.col("line_no"))
    cut = F.min_by((F.col("reach") + F.col("next_top")) / 2, wide)
    plain = F.min_by(F.col("reach") + 0.5 * F.col("body_size"), "line_no")
    return rows.groupBy(*PAGE).agg(F.when((F.count("*") < 2) | (F.coalesce(F.max("body_size"), F.lit(0.0)) == 0), 0.0).otherwise(F.coalesce(cut, plain)).alias("header_bottom"))


def classified(pages: DataFrame, words: DataFrame, images: DataFrame, rules: DataFrame) -> DataFrame:
    """blank, table, figure or text, from how many words, images and drawn lines a page has."""
    out = pages.select(*PAGE)
    for rows, name in ((words, "w"), (images, "i"), (rules, "r")):
        out = out.join(rows.groupBy(*PAGE).agg(F.count("*").alias(name)), PAGE, "left")
    w, i, r = (F.coalesce(c, F.lit(0)) for c in "wir")
    kind = F.when((w < 5) & (i == 0) & (r < 10), "blank").when(r >= 60, "table").when((i >= 1) & (w < 200), "figure").otherwise("text")
    return out.select(*PAGE, kind.alias("page_type"))


def demoted(pages: DataFrame, least: int = 20) -> DataFrame:
    """Text pages of which hardly any text was read are blank."""
    return pages.withColumn("page_type", F.when((F.col("page_type") == "text") & (F.length(F.trim(F.coalesce("text", F.lit("")))) < least), "blank").otherwise(F.col("page_type")))


def _cuts(x0: pa.Array, x1: pa.Array, top: pa.Array, size: pa.Array, chars: pa.Array) -> pa.Array:
    """For each page, for each of its words: the parts that it is cut into, none if it stays whole."""
    left, page = items(x0)
    left, right, top, wsize = doubles(left), doubles(items(x1)[0]) + 0.5, doubles(items(top)[0]), doubles(items(size)[0])
    rows, char_page = items(chars)
    text, cx0, cx1, ctop, csize = (pc.struct_field(rows, n) if n == "text" else doubles(pc.struct_field(rows, n)) for n in ("text", "x0", "x1", "top", "size"))
    w, c = met(page, (left - 0.5, right, top - LINE_TOLERANCE, top + LINE_TOLERANCE), char_page, cx0, ctop, 4 * LINE_TOLERANCE)
    inside = cx1[c] <= right[w]
    w, c = w[inside], c[inside]
    order = np.lexsort((cx0[c], w))
    w, c = w[order], c[order]
    same = np.r_[False, w[1:] == w[:-1]][: len(w)]  # as the character before
    if np.any(same[1:] & (cx0[c[1:]] == cx0[c[:-1]])):  # in one place: by text, then by box
        coded = text.dictionary_encode()
        rank = np.argsort(np.argsort(np.array([t or "" for t in coded.dictionary.to_pylist()], object), kind="stable"), kind="stable")
        code = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((csize[c], cx1[c], rank[code[c]] if len(rank) else c, cx0[c], w))
        w, c = w[order], c[order]
    known = np.where((csize == 0) | np.isnan(csize), np.nan, csize)[c]
    for other in (np.r_[np.nan, known[:-1]][: len(c)], np.where(wsize == 0, np.nan, wsize)[w], 10.0):
        known = np.where(np.isnan(known), other, known)
    gap = cx0[c] - np.r_[np.nan, cx1[c[:-1]]][: len(c)]
    new = same & (gap >= np.maximum(WORD_GAP, WORD_GAP_SHARE * known))
    start = np.flatnonzero(~same | new)
    end, owner = np.r_[start[1:], len(c)][: len(start)], w[start]
    many = np.bincount(owner, minlength=len(left))[owner] > 1
    start, end, owner = start[many], end[many], owner[many]
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(end - start), pa.int32()), pc.fill_null(text, "").take(pa.array(c[ragged(start, end - start)]))), "")
    parts = pa.StructArray.from_arrays([pa.array(number, pa.int32()), joined, pa.array(cx0[c[start]]), pa.array(cx1[c[end - 1]])], ["part", "text", "x0", "x1"])
    return lists(lists(parts, owner, len(left)), page, len(x0))


def split_words(words: DataFrame, chars: DataFrame) -> DataFrame:
    """Words cut where the gap between two of their characters is as wide as a word gap of that size.

    chars: book_id, page_index, text, x0, x1 (not less than x0), top, size. A character belongs to a word if it lies in its
    box, half a point wider, and on its line. A page's words and characters come as one row each, so those that are dealt by
    page stay where they are. Words without at least two characters stay as they are."""
    given = words.groupBy(*PAGE).agg(F.collect_list(F.struct(*words.columns)).alias("_words"))
    drawn = chars.where(F.col("x0").isNotNull() & F.col("top").isNotNull()).groupBy(*PAGE).agg(F.collect_list(F.struct("text", *(F.col(n).cast("double").alias(n) for n in ("x0", "x1", "top", "size")))).alias("_chars"))
    cuts = F.arrow_udf(_cuts, "array<array<struct<part:int,text:string,x0:double,x1:double>>>")
    cut = given.join(drawn, PAGE, "left").withColumn("_parts", cuts("_words.x0", "_words.x1", "_words.top", "_words.size", "_chars"))
    each = cut.select(F.posexplode("_words").alias("_no", "_word"), "_parts").select("_word", F.explode_outer(F.element_at("_parts", F.col("_no") + 1)).alias("_part"))
    of = lambda n: F.coalesce(F.col("_part")[n], F.col("_word")[n]).alias(n)
    return each.select(*[F.col("_word")[c].alias(c) for c in words.columns if c not in ("text", "x0", "x1")], F.coalesce(F.col("_part")["part"], F.lit(0)).alias("part"), of("text"), of("x0"), of("x1"))


def glyph_ids(points: DataFrame) -> DataFrame:
    """glyph (its key columns) and an id that is the same wherever and however large the sign is drawn.

    points: book_id, page_index, gap_no, x, y. Points are moved and scaled to 0 to 1000, rounded half to even, sorted and
    hashed."""
    keys = [*PAGE, "gap_no"]
    box = points.groupBy(*keys).agg(F.min("x").alias("mx"), F.min("y").alias("my"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    span = F.when(F.col("span") == 0, 1.0).otherwise(F.col("span"))
    scaled = points.join(box, keys).select(*keys, F.bround((F.col("x") - F.col("mx")) / span * 1000).cast("long").alias("sx"), F.bround((F.col("y") - F.col("my")) / span * 1000).cast("long").alias("sy"))
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sx", "sy"))), lambda p: F.concat(F.lit("("), p["sx"].cast("string"), F.lit(", "), p["sy"].cast("string"), F.lit(")"))), ", "), F.lit("]"))
    return scaled.groupBy(*keys).agg(F.left(F.sha1(shown), F.lit(8)).alias("glyph_id"))


def gap_shapes(lined_words: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes drawn in the gap before a word of its line: the word, and which shape. shapes: ..., shape_no, x0, x1, top, bottom.

    Gaps and the middles of shapes meet in cells of the page, so a shape is compared with the gaps near it alone."""
    order = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "word_no")
    line = Window.partitionBy(*PAGE, "line_no")
    gaps = lined_words.select(*PAGE, "word_no", F.col("x0").alias("right"), F.lag("x1").over(order).alias("left"), F.min("top").over(line).alias("ltop"), F.max("bottom").over(line).alias("lbottom")).where(F.col("right") - F.col("left") > 2)
    s = shapes.select(*PAGE, "shape_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    inside = points_in_boxes(
        gaps, s, PAGE, (F.col("left") - 1, F.col("right") + 1, F.col("cx")), (F.col("ltop") - 3, F.col("lbottom") + 3, F.col("cy")), (32.0, 16.0),
    )
    return inside.where((F.col("cx") > F.col("left") - 1) & (F.col("cx") < F.col("right") + 1) & (F.col("cy") > F.col("ltop") - 3) & (F.col("cy") < F.col("lbottom") + 3)).select(*PAGE, F.col("word_no").alias("gap_no"), "shape_no")


def gap_glyphs(found: DataFrame, points: DataFrame) -> DataFrame:
    """gap_no and glyph_id of each gap that shapes are drawn in: the id of all their points, zeros where they have none.

    found: as gap_shapes gives it; points: book_id, page_index, shape_no, x, y."""
    ids = glyph_ids(found.join(points, [*PAGE, "shape_no"]).select(*PAGE, "gap_no", "x", "y"))
    return found.select(*PAGE, "gap_no").distinct().join(ids, [*PAGE, "gap_no"], "left").select(*PAGE, "gap_no", F.coalesce("glyph_id", F.lit("00000000")).alias("glyph_id"))


def dehyphenated(line_texts: DataFrame, keys: list[str]) -> DataFrame:
    """line_texts: keys..., line_no, line. A line that ends in a letter and a hyphen takes the next one on, if that starts
    with a letter; the hyphen stays. Whether two lines join depends on these two alone, so runs are running sums."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    joins = F.coalesce(F.lag("line").over(order).rlike(r"\p{L}-$") & F.col("line").rlike(r"^\p{L}"), F.lit(False))
    runs = line_texts.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("line")).withColumnRenamed("run", "line_no")


def stream_texts(column_words: DataFrame, fn_tops: DataFrame, headers: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """body and footnotes of each page, from its words: per column the words below the header and above the footnotes, and
    those of the footnotes; lines joined by line feeds, columns by blank lines.

    Between two words stands a space where their gap is wide enough, or a mark where a sign is drawn (glyphs: ...,
    gap_no, glyph_id); small digits become note marks."""
    keys = [*PAGE, "column_no", "stream"]
    w = column_words.join(fn_tops, [*PAGE, "column_no"]).join(headers, PAGE, "left").where(F.col("top") >= F.coalesce("header_bottom", F.lit(0.0)))
    w = w.withColumn("stream", F.when(F.col("top") < F.col("fn_top"), "body").otherwise("footnote"))
    w = w.withColumn("text", T.by_font(F.col("text"), F.col("fontname"))) if "fontname" in w.columns else w
    w = w.join(body_size(w, keys).withColumnRenamed("body_size", "median_size"), keys, "left")
    w = w.withColumn("text", T.footnote_marker(F.col("text"), F.col("size"), F.col("median_size")))
    w = w.join(glyphs.select(*PAGE, F.col("gap_no").alias("word_no"), "glyph_id"), [*PAGE, "word_no"], "left") if glyphs is not None else w.withColumn("glyph_id", F.lit(None).cast("string"))
    rows = lined(w, keys)
    order = Window.partitionBy(*keys, "line_no").orderBy("x0", "word_no")
    size = F.coalesce(F.nullif("size", F.lit(0.0)), F.nullif(F.lag("size").over(order), F.lit(0.0)), F.lit(10.0))
    gap = F.col("x0") - F.lag("x1").over(order)
    before = F.when(gap.isNull(), "").when((gap > 2) & F.col("glyph_id").isNotNull(), F.concat(F.lit(" ⟨glyph-"), "glyph_id", F.lit("⟩ "))).when(gap >= F.greatest(F.lit(WORD_GAP), WORD_GAP_SHARE * size), " ").otherwise("")
    texts = rows.withColumn("piece", F.concat(before, "text")).groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "piece"))), lambda x: x["piece"]), "").alias("line"))
    whole = dehyphenated(texts, keys).groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    joined = whole.where("text <> ''").groupBy(*PAGE, "stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    one = lambda s: F.coalesce(F.max(F.when(F.col("stream") == s, F.col("text"))), F.lit(""))
    return joined.groupBy(*PAGE).agg(one("body").alias("body"), one("footnote").alias("footnotes"))


def without_label_lines(text: F.Column, label: F.Column) -> F.Column:
    """A stream without the lines that are just the page's label."""
    bare = lambda x: F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")
    return F.trim(F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: ~F.coalesce(bare(x) == label, F.lit(False))), "\n"))


def table_texts(cells: DataFrame) -> DataFrame:
    """cells: book_id, page_index, table_no, row_no, cell_no, cell. Rows joined by bars, tables by blank lines."""
    cell = F.regexp_replace(F.coalesce("cell", F.lit("")), r"\r?\n", " ")
    rows = cells.groupBy(*PAGE, "table_no", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", cell.alias("cell")))), lambda x: x["cell"]), " | ").alias("row"))
    tables = rows.groupBy(*PAGE, "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]), "\n").alias("table"))
    return tables.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "table"))), lambda x: x["table"]), "\n\n").alias("text"))


def text_layer_report(pages: DataFrame) -> DataFrame:
    """Per book: pages, characters, their mean, pages of hardly any text, and whether most are such (a scan)."""
    n = F.length(F.trim(F.coalesce("body", F.lit(""))))
    low = n < LOW_TEXT
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), (F.sum(n).cast("double") / F.count("*")).alias("mean_chars"), F.count_if(low).alias("low_pages"), (F.count_if(low) * 2 > F.count("*")).alias("needs_ocr"))


def layout_distribution(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id", "page_type").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list("page_index")).alias("page_indices"))


def region_map(sizes: DataFrame, headers: DataFrame, gutter: DataFrame, fn_tops: DataFrame) -> DataFrame:
    """The boxes of each page's columns: body and footnotes, below the header."""
    base = sizes.join(headers, PAGE, "left").join(gutter, PAGE, "left").join(fn_tops, PAGE)
    left = F.when(F.col("column_no") == 0, 0.0).otherwise(F.col("gutter").cast("double"))
    right = F.when((F.col("column_no") == 0) & F.col("gutter").isNotNull(), F.col("gutter").cast("double")).otherwise(F.col("width").cast("double"))
    return base.select(*PAGE, "column_no", F.coalesce("header_bottom", F.lit(0.0)).alias("header_bottom"), left.alias("x0"), right.alias("x1"), "fn_top", F.col("height").cast("double").alias("height"))
