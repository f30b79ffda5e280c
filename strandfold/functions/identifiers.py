"""Identifier functions as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols that mean "no gene" in probe annotations.
NO_SYMBOL = ("", "nan", "---")


def canonical_sample_id(raw: Column) -> Column:
    """``TCGA-a-b-01A-01R`` and ``TCGA-a-b-01`` both become ``TCGA-a-b-01A``; other ids stay as they are."""
    parts = F.split(raw, "-")
    vial = F.substring(F.try_element_at(parts, F.lit(4)), 1, 3)
    vial = F.when(F.length(vial) == 2, F.concat(vial, F.lit("A"))).otherwise(vial)
    is_barcode = (F.size(parts) >= 4) & (F.try_element_at(parts, F.lit(1)) == "TCGA")
    return F.when(is_barcode, F.concat_ws("-", F.slice(parts, 1, 3), vial)).otherwise(raw)


def strip_version(identifier: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(identifier, ".", 1)


def cohort_codes(text: Column) -> Column:
    """Comma-separated codes as an upper-case array: trimmed, blanks dropped, first occurrence kept."""
    codes = F.transform(F.split(F.upper(text), ","), lambda code: F.trim(code))
    return F.array_distinct(F.filter(codes, lambda code: code != ""))


def cohort_code_list(values: Iterable[str] | None) -> list[str]:
    """The argument form of :func:`cohort_codes`; an empty selection is an error."""
    codes = (code.strip().upper() for value in values or [] for code in str(value).split(","))
    unique = list(dict.fromkeys(code for code in codes if code))
    if not unique:
        raise ValueError("Select at least one cohort code.")
    return unique


def probe_symbol(text: Column) -> Column:
    """First symbol of an ``A /// B`` list, or NULL where the probe has none."""
    symbol = F.trim(F.get(F.split(text, r"\s*///\s*"), F.lit(0)))
    return F.when(~symbol.isin(*NO_SYMBOL), symbol)


def quoted_attribute(attributes: Column, key: str) -> Column:
    """Value of ``key "value"`` in an annotation attribute string, NULL where absent."""
    return F.nullif(F.regexp_extract(attributes, key + ' "([^"]+)"', 1), F.lit(""))


def split_attribute(text: Column) -> Column:
    """``key: value`` split once at the first colon, both sides trimmed."""
    at = F.locate(":", text)
    key = F.when(at > 0, F.substring_index(text, ":", 1)).otherwise(text)
    value = F.when(at > 0, text.substr(at + F.lit(1), F.length(text))).otherwise(F.lit(""))
    return F.struct(F.trim(key).alias("key"), F.trim(value).alias("value"))
