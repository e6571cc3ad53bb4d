"""Text rules: value cleaning, names, labels and the text that describes a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space when a value is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def clean_value(value: Column) -> Column:
    """Normal form in which values of two columns are compared."""
    return F.lower(strip(value))


def plain_number(text: Column) -> Column:
    """Text of a number in plain notation, without an exponent and without zeros at the end of a fraction.

    The digits stay as they are, so a number has one text whatever type it comes in. Other text is returned unchanged.
    """
    parts = "^(-?)([0-9]+)(?:\\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
    before, after = F.regexp_extract(text, parts, 2), F.regexp_extract(text, parts, 3)
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, parts, 4), F.lit("")).cast("int"), F.lit(0))
    read = F.struct(
        F.regexp_extract(text, parts, 1).alias("sign"), F.concat(before, after).alias("digits"), (F.length(before) + exponent).alias("point")
    )

    def moved(r: Column) -> Column:
        digits, point = r["digits"], r["point"]
        return F.struct(
            r["sign"].alias("sign"),
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.rpad(digits, point, "0"))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
            .alias("number"),
        )

    def signed_text(r: Column) -> Column:
        short = F.when(r["number"].contains("."), F.regexp_replace(r["number"], "\\.?0+$", "")).otherwise(r["number"])
        bare = F.regexp_replace(short, "^0+(?=[0-9])", "")
        return F.when(bare == "0", bare).otherwise(F.concat(r["sign"], bare))

    # Arrays of one, so that each step is computed once and the generated code stays small.
    signed = F.get(F.transform(F.transform(F.array(read), moved), signed_text), F.lit(0))
    # Most numbers are plain already: digits alone, or a fraction that does not end in 0.
    done = text.rlike("^-?(0|[1-9][0-9]*)(\\.[0-9]*[1-9])?$") & (text != "-0")
    return F.when(done | ~text.rlike(parts), text).otherwise(signed)


def written_fraction(data_type: T.DataType) -> bool:
    """Whether numbers of a type may be written in several ways."""
    return isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType))


def raw_text(column: Column, data_type: T.DataType) -> Column:
    """Text of a scalar as Spark writes it; NaN is missing."""
    text = column.cast("string")
    return F.when(~F.isnan(column), text) if isinstance(data_type, (T.DoubleType, T.FloatType)) else text


def scalar_text(column: Column, data_type: T.DataType) -> Column:
    """Text form of a scalar; equal numbers print alike whatever their type, NaN is missing."""
    text = raw_text(column, data_type)
    return plain_number(text) if written_fraction(data_type) else text


# The characters that the next two replace.
def safe_alias(field: Column) -> Column:
    """Field name usable as an alias."""
    return F.translate(field, ":@-", "___")


def safe_domain(domain: Column) -> Column:
    """Domain name usable as a folder name."""
    return F.regexp_replace(domain, "[^a-zA-Z0-9._-]", "_")


def dataset_label(dataset_id: Column, name: Column) -> Column:
    """``name (id)``, or the id alone where there is no other name."""
    shown = F.coalesce(F.nullif(strip(name), F.lit("")), dataset_id)
    return F.when(shown == dataset_id, dataset_id).otherwise(
        F.concat(shown, F.lit(" ("), dataset_id, F.lit(")"))
    )


def column_text(name: Column, values: Column) -> Column:
    """Sentence describing a column by its name and sample values; empty samples are left out."""
    shown = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.concat(
        F.lit("Column: "), name, F.lit(". Sample values: "), F.array_join(shown, ", ")
    )


def endpoint_dataset(column_name: Column) -> Column:
    """Dataset part of ``dataset.column``."""
    return F.substring_index(column_name, ".", 1)


def page_title(html: Column) -> Column:
    """``<meta name="title">`` content, else the stripped ``<title>``; empty text without either."""
    meta = "(?is)<meta\\b(?=[^>]*\\bname\\s*=\\s*[\"']title[\"'])[^>]*\\bcontent\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    title = "(?is)<title[^>]*>(.*?)</title>"
    from_meta = F.concat(F.regexp_extract(html, meta, 1), F.regexp_extract(html, meta, 2))
    return F.when(html.rlike(meta), from_meta).otherwise(strip(F.regexp_extract(html, title, 1)))
