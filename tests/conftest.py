import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("migscope-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


def lines_df(spark, programs: dict[str, str], project="p0"):
    """src_lines of literal programs {path: text}."""
    rows = []
    for path, text in programs.items():
        for i, ln in enumerate(text.split("\n"), start=1):
            rows.append((project, path, i, ln))
    return spark.createDataFrame(rows, "project_id string, path string, line_no int, line string")


def files_df(spark, files: dict[str, str], project="p0"):
    return spark.createDataFrame([(project, p, t) for p, t in files.items()],
                                 "project_id string, path string, content string")
