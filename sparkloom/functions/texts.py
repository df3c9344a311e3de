"""Text clean-up, paths, SQL text, similarity and JSON as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def folded(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def short_name(c: Column) -> Column:
    """The last part of a dotted name, without generic arguments and array brackets."""
    return F.substring_index(F.regexp_replace(c, r"<.*>|\[\]", ""), ".", -1)


def without_receiver(c: Column) -> Column:
    return F.regexp_replace(c, r"^(this|super)\.", "")


def is_type_like(c: Column) -> Column:
    """A dotted name, or a name with a capital first."""
    return c.rlike(r"^[A-Za-z_$][\w$.]*$") & (c.rlike(r"^[A-Z]") | F.contains(c, F.lit(".")))


def route(c: Column) -> Column:
    """A path without query and fragment, one leading slash, no double or trailing ones."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+", "/")
    led = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(F.length(led) > 1, F.regexp_replace(led, r"/$", "")).otherwise(led)


def with_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"\\", "/")


def path_text(c: Column) -> Column:
    """'' for null or ''; else one slash in front and one trailing slash less."""
    led = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    cut = F.when((F.length(led) > 1) & led.endswith("/"), F.substring(led, F.lit(1), F.length(led) - 1)).otherwise(led)
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(cut)


def sql_line(c: Column) -> Column:
    """Tabs as four spaces, no blanks at the end."""
    return F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"\s+$", "")


def without_indent(c: Column, n: Column) -> Column:
    """Up to n leading blanks less."""
    lead = F.length(F.regexp_extract(c, r"^ *", 0))
    return F.substring(c, F.least(lead, n) + 1, F.length(c))


def matching_rate(a: Column, b: Column) -> Column:
    """(1 - edit distance / longer length) in percent, one decimal; 0 of two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.round((1 - F.levenshtein(a, b) / longer) * 100, 1))


def route_tokens(c: Column) -> Column:
    """Lower-case words of a route: parts between / _ . - and at capitals inside words."""
    cut = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(cut), r"[\s/_.\-{}]+"), lambda w: w != ""))


def route_similarity(a: Column, b: Column) -> Column:
    """3 x Jaccard of the routes' words + 2 x share of common last parts + containment (1.0 or 0.7)."""
    x, y = route_tokens(a), route_tokens(b)
    union = F.size(F.array_union(x, y))
    jaccard = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)
    pa, pb = F.reverse(F.split(F.regexp_replace(a, "^/", ""), "/")), F.reverse(F.split(F.regexp_replace(b, "^/", ""), "/"))
    n = F.least(F.size(pa), F.size(pb))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(pa, i) == F.element_at(pb, i))
    first_off = F.array_position(same, False)
    common = F.when(first_off == 0, n).otherwise(first_off - 1)
    inside = F.when(F.contains(a, b), 1.0).when(F.contains(b, a), 0.7).otherwise(0.0)
    return F.round(3 * jaccard + 2 * common / F.greatest(F.size(pa), F.size(pb)) + inside, 6)


def placeholders_filled(c: Column, value: str = "'REPLACED'") -> Column:
    return F.regexp_replace(c, r"[#$]\{[^}]*\}", value)


def without_sql_comments(c: Column) -> Column:
    """Line and block comments go before white space is folded, so a line comment ends with its line."""
    return folded(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))


def sql_tables(c: Column) -> Column:
    """Names of tables that a statement reads or writes, lower-case, in order of their first mention."""
    bare = F.regexp_replace(without_sql_comments(c), r"(?i)\bkey\s+update\b", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?i)\b(?:from|join|update|delete from|insert into)\s+`?([A-Za-z_]\w*)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def sql_tables_or_contained(c: Column, names: list[str]) -> Column:
    """Tables by parsing; those of `names` that the text contains where none is found."""
    found = sql_tables(c)
    listed = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(c), F.lower(n)))
    return F.when(F.size(found) > 0, found).otherwise(listed)


def sheet_name(c: Column) -> Column:
    return F.regexp_replace(F.substring(c, 1, 31), r"[\\/?*\[\]:]", "_")


def address(c: Column, aliases: dict[str, str]) -> Column:
    """Letters, digits and blanks only, lower-case, with aliases put in full."""
    bare = folded(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "))
    return reduce(lambda x, kv: F.regexp_replace(x, rf"\b{kv[0]}\b", kv[1]), aliases.items(), bare)


def without_point_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def fuzzy_label(c: Column, labels: list[str]) -> Column:
    """The label that equals the text (any case), or the first that it contains, or null."""
    exact = F.get(F.filter(F.array(*[F.lit(x) for x in labels]), lambda n: F.lower(n) == F.lower(c)), F.lit(0))
    part = F.get(F.filter(F.array(*[F.lit(x) for x in labels]), lambda n: F.contains(F.lower(c), F.lower(n))), F.lit(0))
    return F.coalesce(exact, part)


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose pattern the text has, in the order given."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def template_pattern(c: Column) -> Column:
    """A path template's `{name}` parts as a pattern for one path part, anchored."""
    literal = F.regexp_replace(c, r"([.+*?^$()\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\{[^}]*\}", "[^/]+"), F.lit("$"))


def json_text(c: Column, is_text: bool = False) -> Column:
    """JSON of a struct, map or array; texts pass unchanged."""
    return c if is_text else F.to_json(c)


def multi_values(c: Column) -> Column:
    """A map of texts as a map of one-element lists."""
    return F.transform_values(c, lambda _, v: F.array(v))


def cache_key(prefix: str, *fields: tuple[str, Column]) -> Column:
    """prefix with field:value pairs joined by colons."""
    parts = [x for name, value in fields for x in (F.lit(name), value.cast("string"))]
    return F.concat_ws(":", F.lit(prefix), *parts)
