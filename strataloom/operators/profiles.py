"""Learner profiles: the latest of each (learner, formation), their text to embed, and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import fresh_path
from ..sources.keyed import KeyedTable

SCHEMA = (
    "learner_id string, formation_id string, completed_modules array<string>, current_module string, progression_pct double, comprehension_score double, "
    "weak_points array<string>, last_interaction_at string, annotations map<string,string>, embedding array<float>, created_at timestamp, updated_at timestamp"
)
KEYS = ["learner_id", "formation_id"]


def text_to_embed(weak_points: Column, annotations: Column) -> Column:
    """Weak points and the values of annotations, joined by blanks; blank parts are left out."""
    parts = F.array(F.array_join(weak_points, " "), F.array_join(F.map_values(annotations), " "))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~is_blank(p)), " ")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str, created: str, kept_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` after the rows of ``new``: the last by ``order`` of each key wins.

    ``created`` stays that of the first row; columns in ``kept_if_null`` keep the latest value that isn't null.  Rows
    of the same order are told apart by all their values, so the result is the same each time.
    """
    rows = stored.withColumn("__new", F.lit(0)).unionByName(new.select(stored.columns).withColumn("__new", F.lit(1)))
    down = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order), F.xxhash64(*[F.col(c).cast("string") if rows.schema[c].dataType.simpleString().startswith("map") else F.col(c) for c in stored.columns]))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("__n", F.row_number().over(down)).withColumn(created, F.min(created).over(Window.partitionBy(*keys)))
    for c in kept_if_null:
        out = out.withColumn(c, F.first(c, ignorenulls=True).over(whole))
    return out.where("__n = 1").drop("__n", "__new")


class ProfileStore:
    """Profiles in a keyed table: a save writes the buckets of its learners anew, a load reads one bucket."""

    def __init__(self, spark: SparkSession, embed=None, path: str | None = None, buckets: int = 64):
        self.embed, self.table = embed, KeyedTable(spark, path or fresh_path(spark, "profiles"), SCHEMA, KEYS, buckets)

    def save(self, profiles: DataFrame) -> list[int]:
        """Upsert ``profiles`` and return the buckets written; a profile without text to embed keeps its old vector."""
        text = text_to_embed(F.col("weak_points"), F.col("annotations"))
        vector = F.when(text != "", self.embed(text)) if self.embed else F.lit(None).cast("array<float>")
        now = F.current_timestamp()
        rows = profiles.withColumns({"embedding": vector, "created_at": now, "updated_at": now})
        return self.table.update(rows, lambda stored, new: upsert(stored, new, KEYS, "updated_at", "created_at", ("embedding",)))

    def load(self, learner_id: str, formation_id: str) -> DataFrame:
        """The profile's row, none if it isn't there."""
        return self.table.lookup(learner_id, formation_id)

    def load_all(self, keys: DataFrame) -> DataFrame:
        """The rows of many (learner_id, formation_id)."""
        return self.table.lookups(keys)
