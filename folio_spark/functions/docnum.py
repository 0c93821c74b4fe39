"""Document numbers: spelling and issuers' names (P5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An issuer's names, the full one first.
ISSUER_NAMES = (("中国证券监督管理委员会", "中国证监会", "证监会"),)
#: The form of a whole document number, and of one inside a text.
WHOLE = r"^[\x{4E00}-\x{9FFF}]{1,30}(?:〔\d{4}〕\d+号|令第\d+号)$"
INLINE = r"((?:中国证券监督管理委员会[\x{4E00}-\x{9FFF}]{1,4}|[\x{4E00}-\x{9FFF}]{1,12})〔\d{4}〕\s*\d+\s*号)"


def docnum_key(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def is_docnum(c: Column) -> Column:
    return F.coalesce(docnum_key(c).rlike(WHOLE), F.lit(False))


def with_docnum(df: DataFrame, col: str, out: str = "docnum") -> DataFrame:
    """df with its document numbers without white space."""
    return df.withColumn(out, docnum_key(F.col(col)))


def docnum_variants(df: DataFrame, col: str = "docnum", out: str = "variant") -> DataFrame:
    """One row per spelling of a number under its issuer's names; the number's own spelling is first (place 0)."""
    own = docnum_key(F.col(col))
    found = F.array(own)
    for names in ISSUER_NAMES:
        for name in sorted(names, key=len):
            others = [F.concat(F.lit(o), F.substring(own, len(name) + 1, 1 << 20)) for o in sorted(names, key=len, reverse=True) if o != name]
            found = F.when(own.startswith(name) & (F.length(own) > len(name)), F.array(own, *others)).otherwise(found)
    return df.select(*df.columns, F.posexplode(found).alias("place", out)).where(F.col(out) != "")
