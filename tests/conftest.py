import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("skein-tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


MESSAGES = (
    "session_id string, line_index long, byte_size long, parse_error boolean, type string, uuid string, parent_uuid string, is_sidechain boolean, role string, name string, message_id string, "
    "is_snapshot_update boolean, operation string, root_content string, model string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>, "
    "blocks array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content_str:string,is_error:boolean>>, ts timestamp_ntz, ingested_at timestamp_ntz"
)


@pytest.fixture
def messages(spark):
    """Makes a messages table from dicts; what a row doesn't name is null."""

    def make(rows):
        names = ["session_id", "line_index", "byte_size", "parse_error", "type", "uuid", "parent_uuid", "is_sidechain", "role", "name", "message_id", "is_snapshot_update", "operation", "root_content", "model", "usage", "blocks", "ts", "ingested_at"]
        block = ["type", "text", "thinking", "id", "name", "input", "tool_use_id", "content_str", "is_error"]
        fix = lambda r: tuple([tuple(b.get(k) for k in block) for b in r[n]] if n == "blocks" and r.get(n) is not None else r.get(n) for n in names)
        return spark.createDataFrame([fix({"session_id": "s", "byte_size": 100, "parse_error": False, **r}) for r in rows], MESSAGES)

    return make
