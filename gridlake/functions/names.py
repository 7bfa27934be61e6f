"""File-name logic on path columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def has_prefix(path: Column | str, prefix: str) -> Column:
    return F.startswith(basename(path), F.lit(prefix))


def has_suffix(path: Column | str, suffix: str) -> Column:
    return F.endswith(_c(path), F.lit(suffix))


def replace_text(path: Column | str, old: str, new: str) -> Column:
    return F.replace(_c(path), F.lit(old), F.lit(new))


def name_prefix(path: Column | str, n: int = 6) -> Column:
    return F.substring(basename(path), 1, n)


def run_stamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd-HHmm")


def numbered(template: str, number: Column | str) -> Column:
    """``template`` holds one %d or %s for the number."""
    return F.format_string(template, _c(number))


def output_name(path: Column | str, old_type: str, suffix: str, new_type: str, directory: str | None = None) -> Column:
    """Name of the product of an input file: type replaced by suffix + type, in another folder if given."""
    name = replace_text(basename(path), old_type, suffix + new_type)
    return name if directory is None else F.concat(F.lit(directory.rstrip("/") + "/"), name)
