"""Feature tables of the reference's tests (FIXTURES.md section 1), built in Spark."""

from pyspark.sql import functions as F

from geoplane.functions import geometry as G
from geoplane.plans.collection import Collection

CITIES = [  # id, name, lon, lat, population, category
    (1, "Paris", 2.35, 48.86, 2161000, "capital"),
    (2, "Lyon", 4.83, 45.76, 516092, "major"),
    (3, "Marseille", 5.37, 43.30, 870018, "major"),
    (4, "Toulouse", 1.44, 43.60, 493465, "major"),
    (5, "Nantes", -1.55, 47.22, 314138, "medium"),
]


def point_collection(spark, rows, schema, name="sites", **kw) -> Collection:
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("geom", G.point(F.col("lon"), F.col("lat"))).drop("lon", "lat")
    df = G.with_bbox(df)
    return Collection(df, name=name, **kw)


def sites(spark):
    return point_collection(spark, [(r[0], r[1], r[2], r[3]) for r in CITIES[:3]],
                            "id int, name string, lon double, lat double")


def cities(spark):
    return point_collection(spark, CITIES, "id int, name string, lon double, lat double, population int, category string",
                            name="cities")


def events(spark):
    import datetime as dt
    rows = [(1, "A", dt.datetime(2024, 1, 15, 10, 0), 2.35, 48.86),
            (2, "B", dt.datetime(2024, 6, 20, 14, 0), 4.83, 45.76),
            (3, "C", dt.datetime(2025, 3, 1, 9, 0), 5.37, 43.30)]
    return point_collection(spark, rows, "id int, name string, event_date timestamp, lon double, lat double",
                            name="events", datetime_column="event_date")
