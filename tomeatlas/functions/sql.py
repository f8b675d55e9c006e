"""The text, distance and similarity rules as SQL functions of a session.

Each is defined in SQL, so Spark puts its body into the plan of the query that calls it: no Python runs, and filters,
column pruning and code generation work as for built-in functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tomeatlas.functions.expr import WHITESPACE_RUN
from tomeatlas.functions.geo import EARTH_M

#: Name, parameters, result and body; later ones call earlier ones.
FUNCTIONS = [
    ("norm_text", "s STRING", "STRING", f"trim(lower(regexp_replace(coalesce(s, ''), r'{WHITESPACE_RUN}', ' ')))"),
    ("slug", "s STRING", "STRING", "coalesce(nullif(btrim(regexp_replace(norm_text(s), '[^a-z0-9]+', '-'), '-'), ''), 'unknown')"),
    (
        "half_chord", "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
        "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)",
    ),
    (
        "haversine_m", "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
        f"{2 * EARTH_M}D * atan2(sqrt(half_chord(lon1, lat1, lon2, lat2)), sqrt(greatest(1D - half_chord(lon1, lat1, lon2, lat2), 0D)))",
    ),
    (
        "trigrams", "s STRING", "ARRAY<STRING>",
        r"array_distinct(flatten(transform(filter(split(lower(coalesce(s, '')), r'[^\p{L}\p{N}]+'), w -> w <> ''), "
        "w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))",
    ),
    (
        "set_similarity", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE",
        "coalesce(try_divide(size(array_intersect(a, b)), size(a) + size(b) - size(array_intersect(a, b))), 0D)",
    ),
    ("trigram_similarity", "a STRING, b STRING", "DOUBLE", "set_similarity(trigrams(a), trigrams(b))"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Define all functions for the session, again if they are there, and return their names.

    ``norm_text`` and ``slug`` take a null as empty, ``haversine_m`` gives null for a null coordinate, and
    ``trigram_similarity`` gives 0 where neither text has a letter or digit.
    """
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
