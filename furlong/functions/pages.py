"""Column functions over saved pages and the tables in them; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.parse import SPACE

#: The columns that hold where rows come from.
URL_COLUMNS = ["source_url", "race_url", "url", "page_url", "request_url"]
_URL = f"(?iU)https?://[^{SPACE}<>'\"\\])]+"


def extract_ids(html: Column, year: Column) -> Column:
    """The distinct 12-digit race ids of a year, sorted: course 01 to 10, race 01 to 12."""
    found = F.array_union(F.regexp_extract_all(html, F.lit("(?<![0-9])[0-9]{12}(?![0-9])"), F.lit(0)), F.regexp_extract_all(html, F.lit("race_id[=/]([0-9]{12})"), F.lit(1)))
    fits = lambda x: (F.substring(x, 1, 4) == year) & F.substring(x, 5, 2).between("01", "10") & F.substring(x, 11, 2).between("01", "12")
    return F.array_sort(F.filter(found, fits))


def group_attribute(html: Column, date: Column) -> Column:
    """The group of the first tag that has this date and a group that isn't blank; the attributes may stand in either order."""
    tags = F.regexp_extract_all(html, F.lit("<[^<>]+>"), F.lit(0))
    value = lambda tag, name: F.regexp_extract(tag, f"\\s{name}=[\"']([^\"']*)[\"']", 1)
    fits = F.filter(tags, lambda t: (value(t, "date") == date) & (F.trim(value(t, "group")) != ""))
    return F.trim(value(F.get(fits, F.lit(0)), "group"))


def normalise_charset(html: Column) -> Column:
    """Declared character sets are UTF-8, as the stored text is: those of meta tags, then those within any content attribute."""
    own = F.regexp_replace(html, r"(?i)(<meta\b[^>]*\bcharset\s*=\s*[\"']?)[^\"'\s/>]+", "$1UTF-8")
    return F.regexp_replace(own, r"(?i)(content\s*=\s*[\"'][^\"']*?charset\s*=\s*)[^;\"'\s/>]+", "$1UTF-8")


def urls(text: Column) -> Column:
    """Distinct addresses in order of appearance, in any case, without punctuation at their ends. White space of every kind,
    quotes, angle brackets and closing brackets end one."""
    found = F.regexp_extract_all(text, F.lit(_URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,;:!?、。】」』]+$", "")))


def texts(value: Column, kind: T.DataType) -> Column:
    """All texts in a value of this type, in order, as one array: those of structs, arrays and the values of maps, however deep
    they are; other values count as they are written. NULLs are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        parts = [texts(value.getField(f.name), f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: texts(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return texts(F.map_values(value), T.ArrayType(kind.valueType))
    return F.when(value.isNotNull(), F.array(value.cast("string"))).otherwise(none)


def nested_urls(value: Column, kind: T.DataType) -> Column:
    """The addresses in all texts of a value, distinct, in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(texts(value, kind), urls)))


def source_urls(df: DataFrame) -> Column:
    """The addresses in those of the URL_COLUMNS that df has, column by column."""
    own = [F.coalesce(nested_urls(F.col(n), df.schema[n].dataType), F.array().cast("array<string>")) for n in URL_COLUMNS if n in df.columns]
    return F.array_distinct(F.concat(*own)) if own else F.array().cast("array<string>")


def race_id_count(html: Column) -> Column:
    """How many distinct numbers of just 12 digits a page has."""
    return F.size(F.array_distinct(F.regexp_extract_all(html, F.lit("(?<![0-9])[0-9]{12}(?![0-9])"), F.lit(0)))).cast("long")


def normalise_headers(header: Column) -> Column:
    """Headings without white space; one that is empty, nan or Unnamed is column_i."""
    bare = F.transform(header, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", ""))
    return F.transform(bare, lambda x, i: F.when((x == "") | (F.lower(x) == "nan") | x.startswith("Unnamed"), F.concat(F.lit("column_"), i.cast("string"))).otherwise(x))


def has_heading(header: Column, part: str) -> Column:
    return F.exists(header, lambda x: x.contains(part))


def table_score(header: Column, n_rows: Column, parts: dict[str, str], historical: Column) -> Column:
    """How much a table looks like runners. parts: what the headings of name, jockey, number and finish contain."""
    points = lambda name, n: F.when(has_heading(header, parts[name]), n).otherwise(0)
    finish = has_heading(header, parts["finish"])
    return points("name", 4) + points("jockey", 2) + points("number", 2) + F.when(historical & finish, 5).when(~historical & ~finish, 1).otherwise(0) + F.when(n_rows >= 5, 1).otherwise(0)


def heading_index(header: Column, candidates: list[str], position: int | None = None) -> Column:
    """The index (from 0) of the first heading that contains the first candidate that any contains; else the position."""
    index = lambda c: F.nullif(F.array_position(F.transform(header, lambda x: x.contains(c)), F.lit(True)).cast("int"), F.lit(0)) - 1  # noqa: E731, B023
    return F.coalesce(*(index(c) for c in candidates), F.lit(position).cast("int"))


def page_name(race_id: Column, course: Column, date: Column, number: Column, name: Column) -> Column:
    return F.concat_ws("_", race_id, course, F.date_format(date, "yyyyMMdd"), F.format_string("R%02d", number), name)


def prediction_date(at: Column, opens: int = 9) -> Column:
    """Before the hour it is the same day, else the next."""
    day = F.to_date(at)
    return F.when(F.hour(at) < opens, day).otherwise(F.date_add(day, 1))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.format_string("%.1f", x * 100), F.lit("%"))).otherwise("-")


def split_paths(paths: Column) -> Column:
    return F.filter(F.transform(F.split(paths, ";"), lambda x: F.trim(x)), lambda x: x != "")
