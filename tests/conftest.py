import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from drivetrove import Catalog  # noqa: E402
from drivetrove.schema import TABLES, conform  # noqa: E402
from drivetrove.sources import ingest  # noqa: E402

NODES = ("disk_name string, local_idx bigint, parent_idx bigint, name string, is_folder boolean, "
         "size_logical bigint, size_physical bigint, created bigint, modified bigint")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def nodes(spark):
    """Import trees from ``{disk: [(name, parent, is_folder, size[, physical, created, modified])]}``."""
    def make(trees, **extra):
        rows = []
        for disk, items in trees.items():
            for i, (name, parent, folder, size, *rest) in enumerate(items):
                physical, created, modified = (list(rest) + [size, 0, 0][len(rest):])[:3]
                rows.append((disk, i, parent, name, folder, size, physical, created, modified))
        return spark.createDataFrame(rows, NODES)
    return make


@pytest.fixture(scope="session")
def load(spark, nodes):
    """A catalogue with the given trees imported."""
    def make(trees):
        return ingest.bulk_ingest(Catalog(spark, {}), nodes(trees))
    return make


SF28 = [
    ("SF28", -1, True, 0), ("CLIP", 0, True, 0),
    ("C0001.MP4", 1, False, 4563402752, 4563406848, 1685577600, 1685581200),
    ("B-ROLL.MOV", 1, False, 1000000000, 1000001024),
]
BACKUP = [("BACKUP", -1, True, 0), ("CLIP", 0, True, 0), ("C0001.MP4", 1, False, 1000000)]


def rows(df, *columns):
    """Sorted tuples of a frame."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def entry_id(cat, path):
    return cat.entries.filter(F.col("path") == path).first()["id"]


def typed(spark, table, data, columns):
    """A table with only some columns given, the others NULL."""
    schema = {f.name: f.dataType.simpleString() for f in TABLES[table]}
    return conform(spark.createDataFrame(data, ", ".join(f"{c} {schema[c]}" for c in columns)), table)
