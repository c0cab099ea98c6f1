"""License rules as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Order matters: cc-by-sa is tested before cc-by, which it contains.
LICENSE_KEYS = (
    ("cc0", "CC0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("public domain", "CC0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc-by-sa", "CC-BY-SA-4.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by", "CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/"),
)
DEFAULT_ALLOWED = ("cc0", "public domain", "cc-by")


def resolve_license(
    short_name: Column, include_cc_by_sa: bool = False, strict: bool = False
) -> Column:
    """Struct (license_type, license_url) of a short name, or null to reject.

    The first key contained in the lower-cased name decides. By default a
    non-commercial name such as ``CC-BY-NC 4.0`` passes as CC-BY, and
    ``CC BY 4.0`` (with spaces) matches nothing. ``strict`` rejects NC and ND
    terms and any CC-BY version other than 4.0, and treats spaces as dashes.
    """
    name = F.lower(F.coalesce(short_name, F.lit("")))
    none = F.lit(None).cast("struct<license_type:string,license_url:string>")
    allowed = set(DEFAULT_ALLOWED) | ({"cc-by-sa"} if include_cc_by_sa else set())
    if strict:
        name = F.when(name.rlike(r"^cc[ -]"), F.regexp_replace(name, r"\s+", "-")).otherwise(name)
    choice = None
    for key, license_type, license_url in LICENSE_KEYS:
        value = none
        if key in allowed:
            value = F.struct(
                F.lit(license_type).alias("license_type"), F.lit(license_url).alias("license_url")
            )
            if strict and key.startswith("cc-by"):
                value = F.when(
                    ~name.rlike(r"-(nc|nd)\b") & name.rlike(r"^cc-by(-sa)?-4\.0$"), value
                )
        test = F.contains(name, F.lit(key))
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice.otherwise(none)


def license_from_url(url: Column, strict: bool = False) -> Column:
    """License type of a license URL; unknown URLs count as CC-BY-2.0.

    ``strict`` yields null for an unknown URL, so that the row can be rejected.
    """
    text = F.lower(F.coalesce(url, F.lit("")))

    def has(part):
        return F.contains(text, F.lit(part))

    return (
        F.when(has("cc0") | has("publicdomain"), "CC0-1.0")
        .when(has("by/4.0"), "CC-BY-4.0")
        .when(has("by/2"), "CC-BY-2.0")
        .otherwise(F.lit(None).cast("string") if strict else F.lit("CC-BY-2.0"))
    )
