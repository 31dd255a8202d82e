"""One-row JSON files that describe a stored index, and face records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the metric spaces.
SPACES = {"ip": 0, "l2": 1, "cosine": 2}
_DDL = "dimension int, space_type int, item_count long, algorithm string, links int, build_width int, created_at string, description string"


@dataclass(frozen=True)
class Metadata:
    dimension: int
    space_type: int
    item_count: int
    algorithm: str = "ivfpq"
    links: int = 16
    build_width: int = 200
    created_at: str | None = None
    description: str | None = None


def write(spark: SparkSession, path: str, own: Metadata) -> None:
    row = spark.createDataFrame([tuple(asdict(own).values())], _DDL)
    row.withColumn("created_at", F.coalesce("created_at", F.current_timestamp().cast("string"))).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read(spark: SparkSession, path: str) -> Metadata:
    row = spark.read.schema(_DDL).json(f"{path}/metadata").first()
    return Metadata(**{f.name: row[f.name] for f in fields(Metadata)})


def outdated(stored: Metadata | None, current: Metadata) -> bool:
    """Whether a local copy has to be replaced: missing, or of another size."""
    return stored is None or stored.item_count != current.item_count


def write_paths(items: DataFrame, path: str) -> None:
    """The map from ids to files (id, path) of an index."""
    items.select("id", "path").write.mode("overwrite").json(f"{path}/paths")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, path string").json(f"{path}/paths")


def ensure_copy(spark: SparkSession, source: str, target: str, tables: Sequence[str]) -> bool:
    """Copies an index's tables and metadata unless the target has one of the same size; whether it did."""
    current = read(spark, source)
    try:
        stored = read(spark, target)
    except AnalysisException:  # nothing there
        stored = None
    if not outdated(stored, current):
        return False
    for name in tables:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    write(spark, target, current)
    return True


def write_faces(faces: DataFrame, path: str) -> None:
    """Face records with their embeddings, and the labels as JSON."""
    faces.write.mode("overwrite").parquet(f"{path}/face_records")
    faces.filter(F.trim("person_label") != "").select("person_id", "person_label").distinct().write.mode("overwrite").json(f"{path}/person_labels")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """Stored faces, with the stored labels put back on faces that lack one."""
    labels = spark.read.schema("person_id long, person_label string").json(f"{path}/person_labels").groupBy("person_id").agg(F.min("person_label").alias("stored"))
    faces = spark.read.parquet(f"{path}/face_records")
    return faces.join(labels, "person_id", "left").withColumn("person_label", F.coalesce("person_label", "stored")).drop("stored")
