"""The most used keys as SQL functions, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, and body over the string x. functions/keys.py has the same as columns.
FUNCTIONS = {
    "doi_key": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(x, ''))), r'^https?://dx\.doi\.org/', ''), r'^https?://doi\.org/', ''), '^doi:', ''), r'^doi\.org/', '')",
    "page_key": r"trim(regexp_replace(coalesce(x, ''), r'\s*[-–—]+\s*', '-'))",
    "publisher_key": "lower(trim(coalesce(x, '')))",
    "abstract_hash": r"sha2(trim(regexp_replace(replace(coalesce(x, ''), r'\', ''), r'\s+', ' ')), 256)",
    "url_host": r"lower(regexp_extract(trim(coalesce(x, '')), r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))",
    "without_tiers": r"array_join(filter(split(x, r',\s*'), t -> NOT t rlike r'^\s*EVIDENCE-[A-Z]+\s*$'), ', ')",
}


def register(spark: SparkSession) -> list[str]:
    """Create all as temporary functions of the session; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return list(FUNCTIONS)
