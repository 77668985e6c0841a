"""Labels of races, models and values, and looked-up codes; NULL is written out where a label has a word for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How datasets and models are called, and marks of truth.
DATASETS = {"historical": "学習用", "upcoming": "予想用"}
MODELS = {"top3": "各馬が3着以内に入る確率を予測するモデル"}
YES, NO = "○", "-"


def lookup(code: Column, values: dict[str, str]) -> Column:
    """The value of a code; NULL for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), code)


def race_number(race_id: Column) -> Column:
    """The last two characters as a number, where they are digits."""
    return F.regexp_extract(race_id, "([0-9]{2})$", 1).try_cast("int")


def index_label(x: Column) -> Column:
    """Two digits, or a dash."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.format_string("%.2f", x)).otherwise("-")


def mark(x: Column) -> Column:
    return F.when(x, YES).otherwise(NO)


def dataset_label(kind: Column) -> Column:
    return F.coalesce(lookup(kind, DATASETS), kind)


def race_label(date: Column, course: Column, number: Column, name: Column, kind: Column) -> Column:
    of = F.coalesce(F.concat(number.cast("string"), F.lit("R")), F.lit("レース番号不明"))
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), F.coalesce(course, F.lit("")), F.lit(" "), of, F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" ["), dataset_label(kind), F.lit("]"))


def model_label(target: Column, created_at: Column, test_auc: Column, run_id: Column) -> Column:
    kind = F.coalesce(lookup(target, MODELS), F.concat(F.lit("モデル種別: "), target))
    at = F.coalesce(F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), F.lit("作成日時不明"))
    auc = F.when(test_auc.isNotNull() & ~F.isnan(test_auc), F.format_string("%.3f", test_auc)).otherwise("-")
    return F.concat(kind, F.lit("｜"), at, F.lit("｜テストAUC "), auc, F.lit("｜"), run_id)


def date_limit(at: Column, days: int = 7) -> Column:
    """The last day that can be predicted."""
    return F.date_add(F.to_date(at), days)


def year_end(year: Column, today: Column) -> Column:
    """The last day of a year that isn't after today."""
    return F.least(F.make_date(year, F.lit(12), F.lit(31)), F.to_date(today))
