"""The shape of a notes-set, checked by path: a row for each violation, in one scan and without a shuffle.

A notes-set is taken as a VARIANT, so any JSON can be checked, whatever its members. The rules stand in `NOTES` as data; one
expression walks them: members of objects by name, members of lists by place. Paths are like statements/0/evidence/1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.anchor import PAGE
from marginalia.sources.derived import BASES, RELATIONS, TYPES

_NONE = "array<struct<rule:string,item:string,detail:string>>"


@dataclass(frozen=True)
class Shape:
    """What a value must be. kind: object, list, string, integer or number. Each bound holds for values of its kind alone."""

    kind: str
    one_of: tuple[str, ...] = ()
    equals: int | None = None
    pattern: str | None = None
    shortest: int = 0
    least: int | None = None
    fewest: int = 0
    most: int | None = None
    items: Shape | None = None
    members: dict[str, Shape] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    #: From the members' texts (null where there is none or it is no text) and their names: what else must be there, and when.
    also: Callable[[Callable[[str], Column], Column], list[tuple[Column, str]]] | None = None


def _named(prefix: str) -> Shape:
    return Shape("string", pattern=f"^{prefix}[a-z0-9][a-z0-9-]*$")


def _page_or_chapter(text: Callable[[str], Column], names: Column) -> list[tuple[Column, str]]:
    page = ~F.array_contains(names, "scope") | F.coalesce(text("scope") == "page", F.lit(False))
    return [(page, "page_index"), (F.coalesce(text("scope") == "chapter", F.lit(False)), "page_range")]


def _quoted(text: Callable[[str], Column], names: Column) -> list[tuple[Column, str]]:
    quote = ~F.array_contains(names, "kind") | F.coalesce(text("kind") == "text", F.lit(False))
    return [(quote, "excerpt"), (quote, "source")]


#: Names, vocabularies, patterns and bounds of the format.
TEXT, FULL, PLACE, SLUG = Shape("string"), Shape("string", shortest=1), Shape("integer", least=0), _named("")
TERM, EVIDENCE, STATEMENT = _named("t-"), _named("e-"), _named("s-")
SOURCE = Shape(
    "object", needs=("document",), also=_page_or_chapter,
    members={"document": FULL, "scope": Shape("string", one_of=("page", "chapter")), "page_label": TEXT, "page_index": PLACE, "chapter_id": TEXT, "chapter_title": TEXT, "page_range": Shape("list", items=PLACE, fewest=2, most=2)},
)
QUOTE = Shape(
    "object", needs=("id",), also=_quoted,
    members={
        "id": EVIDENCE, "kind": Shape("string", one_of=("text", "figure", "table")), "excerpt": FULL, "excerpt_translation": TEXT, "source": Shape("string", one_of=("body", "footnote")),
        "script": TEXT, "locator": TEXT, "caption": TEXT, "bbox": Shape("list", items=Shape("number"), fewest=4, most=4), "page_label": TEXT, "page_index": PLACE,
    },
)
NOTES = Shape(
    "object", needs=("schema_version", "source", "evidence", "statements"),
    members={
        "schema_version": Shape("integer", equals=1),
        "source": SOURCE,
        "generation": Shape("object", members={"model": TEXT, "effort": TEXT, "max_tokens": Shape("integer")}),
        "detected_language": FULL,
        "terms": Shape("list", items=Shape("object", needs=("id", "label"), members={"id": TERM, "label": FULL})),
        "evidence": Shape("list", items=QUOTE),
        "statements": Shape("list", items=Shape("object", needs=("id", "type", "text", "evidence"), members={"id": STATEMENT, "type": Shape("string", one_of=TYPES), "basis": Shape("string", one_of=BASES), "text": FULL, "terms": Shape("list", items=TERM), "evidence": Shape("list", items=EVIDENCE, fewest=1)})),
        "relations": Shape("list", items=Shape("object", needs=("from", "to", "type"), members={"from": SLUG, "to": SLUG, "type": Shape("string", one_of=RELATIONS)})),
    },
)


def _found(broken: Column, rule: str, path: Column, detail: Column) -> Column:
    """The problem, in a list, if it is one."""
    one = F.struct(F.lit(rule).alias("rule"), F.when(path == "", "<root>").otherwise(path).alias("item"), detail.cast("string").alias("detail"))
    return F.when(F.coalesce(broken, F.lit(False)), F.array(one)).otherwise(F.array().cast(_NONE))


def _scalar(value: Column) -> Column:
    """string, number, boolean or null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    number = name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(name == "STRING", "string").when(number, "number").when(name == "BOOLEAN", "boolean").otherwise("null")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """A list of problems that names the value often, with the value worked out once."""
    return F.flatten(F.transform(F.array(value), then))


def problems_of(value: Column, shape: Shape, path: Column) -> Column:
    """The violations within a value, as a list of rule, item (the path) and detail."""
    read = lambda as_type: F.try_variant_get(value, "$", as_type)
    opened = F.struct(value.alias("value"), read("map<string,variant>").alias("own"), read("array<variant>").alias("all"))
    kind = lambda x: F.when(x["own"].isNotNull(), "object").when(x["all"].isNotNull(), "list").otherwise(_scalar(x["value"]))
    return _with(opened, lambda x: _with(kind(x), lambda k: _problems(x, k, shape, path)))


def _problems(opened: Column, kind: Column, shape: Shape, path: Column) -> Column:
    value = opened["value"]
    number = F.when(kind == "number", F.try_variant_get(value, "$", "double"))
    right = (kind == "number") & (number == F.floor(number)) if shape.kind == "integer" else kind == shape.kind
    parts = [_found(~right, "type", path, kind)]
    text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    shown = F.coalesce(text, F.to_json(value))
    if shape.one_of:
        parts.append(_found(text.isNull() | ~text.isin(*shape.one_of), "enum", path, shown))
    if shape.equals is not None:
        parts.append(_found(number.isNull() | (number != shape.equals), "const", path, shown))
    if shape.pattern:
        parts.append(_found(~text.rlike(shape.pattern), "pattern", path, shown))
    if shape.shortest:
        parts.append(_found(F.length(text) < shape.shortest, "minLength", path, shown))
    if shape.least is not None:
        parts.append(_found(number < shape.least, "minimum", path, shown))
    if shape.kind == "list":
        parts.append(_listed(opened["all"], shape, path))
    if shape.kind == "object":
        parts.append(_members(opened["own"], shape, path))
    return F.concat(*parts)


def _listed(all_: Column, shape: Shape, path: Column) -> Column:
    parts = []
    if shape.fewest:
        parts.append(_found(F.size(all_) < shape.fewest, "minItems", path, F.size(all_)))
    if shape.most is not None:
        parts.append(_found(F.size(all_) > shape.most, "maxItems", path, F.size(all_)))
    each = F.transform(all_, lambda x, i: problems_of(x, shape.items, F.concat(path, F.lit("/"), i.cast("string"))))
    return F.concat(*parts, F.coalesce(F.flatten(each), F.array().cast(_NONE)))


def _members(own: Column, shape: Shape, path: Column) -> Column:
    names = F.map_keys(own)
    extra = F.array_except(names, F.array(*map(F.lit, shape.members)))
    parts = [_found(F.size(extra) > 0, "unknown", path, F.array_join(F.sort_array(extra), ","))]
    parts += [_found(~F.array_contains(names, n), "required", path, F.lit(n)) for n in shape.needs]
    if shape.also:
        text = lambda n: F.when(_scalar(own[n]) == "string", F.try_variant_get(own[n], "$", "string"))
        parts += [_found(asked & ~F.array_contains(names, n), "required", path, F.lit(n)) for asked, n in shape.also(text, names)]
    for name, inner in shape.members.items():
        at = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f"/{name}")))
        parts.append(F.when(F.coalesce(F.array_contains(names, name), F.lit(False)), problems_of(own[name], inner, at)).otherwise(F.array().cast(_NONE)))
    return F.concat(*parts)


def notes_problems(rows: DataFrame, notes: str = "notes") -> DataFrame:
    """book_id, page_index, rule, item (the path) and detail of each violation. rows: PAGE and the notes-set as JSON; texts that
    are no JSON give no rows (they aren't readable, which is counted elsewhere)."""
    values = rows.select(*PAGE, F.try_parse_json(notes).alias("value")).where("value is not null")
    return values.select(*PAGE, F.explode(problems_of(F.col("value"), NOTES, F.lit(""))).alias("p")).select(*PAGE, "p.rule", "p.item", "p.detail")
