"""Explicit schemas for the staging inputs (no inference anywhere).

Staging files are bound to these schemas by column *name* (see ``csv_files``), so
files may carry extra columns or a different column order.
"""

from __future__ import annotations

from pyspark.sql import types as T

I, L, D, S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_RESULT_HEAD = (("raceId", I), ("driverId", L), ("constructorId", I), ("number", I), ("grid", I),
                ("position", I), ("positionText", S), ("positionOrder", I), ("points", D), ("laps", I),
                ("time", S), ("milliseconds", L), ("fastestLap", I))

STAGING: dict[str, T.StructType] = {
    "circuits": _schema(("circuitId", I), ("circuitRef", S), ("name", S), ("location", S), ("country", S),
                        ("lat", D), ("lng", D), ("alt", D), ("url", S)),
    "constructors": _schema(("constructorId", I), ("constructorRef", S), ("name", S), ("nationality", S),
                            ("url", S)),
    "constructor_color": _schema(("constructorId", I), ("name", S), ("auto_color", S), ("custom_color", S)),
    "drivers": _schema(("driverId", L), ("driverRef", S), ("number", I), ("code", S), ("forename", S),
                       ("surname", S), ("dob", S), ("nationality", S), ("url", S)),
    "races": _schema(("raceId", I), ("circuitId", I), ("year", I), ("round", I), ("name", S), ("date", S),
                     ("time", S), ("url", S)),
    "seasons": _schema(("year", I), ("url", S)),
    "status": _schema(("statusId", I), ("status", S)),
    "results": _schema(*_RESULT_HEAD, ("rank", I), ("fastestLapTime", S), ("fastestLapSpeed", D),
                       ("statusId", I)),
    "sprint_results": _schema(*_RESULT_HEAD, ("fastestLapTime", S), ("statusId", I)),
    "lap_times": _schema(("raceId", I), ("driverId", L), ("lap", I), ("position", I), ("time", S),
                         ("milliseconds", L)),
    "pit_stops": _schema(("raceId", I), ("driverId", L), ("lap", I), ("stop", I), ("time", S),
                         ("duration", S), ("milliseconds", L)),
    "qualifying": _schema(("raceId", I), ("driverId", L), ("constructorId", I), ("number", I),
                          ("position", I), ("q1", S), ("q2", S), ("q3", S)),
}


def conform_columns(df, schema: T.StructType):
    """Select ``schema``'s columns by name with their declared types (untyped NULL -> typed)."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
