from pyspark.sql import functions as F

from docketry.llm import common


def test_stored_and_clear(spark):
    df = common.stored(spark.range(5), "some")
    assert df.count() == 5
    common.clear(spark)
    try:
        left = df.count()
    except Exception:
        left = 0
    assert left == 0


def test_ascii_lower(spark):
    rows = spark.createDataFrame([("ABz",), ("AÉİZ",), (None,), ("",)], "t string").select(common.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["abz", "aÉİz", None, ""]


def test_clean_name(spark):
    df = spark.range(1).select(F.lit(1).alias("__x"), F.lit(2).alias("__X_"))
    assert common.clean_name(df, "x") == "__x__"


def test_tables_and_folders_are_cleared(spark):
    table = common.bucketed(spark.range(5), "some-run", 2, ["id"])
    assert table.count() == 5 and any(t.name.startswith("some_run") for t in spark.catalog.listTables())
    path = common._stored[-1]
    common.clear(spark)
    assert not any(t.name.startswith("some_run") for t in spark.catalog.listTables()) and not common._tables and not common._stored
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert common.shared_dir(Session(spark_master="spark://a:7077", spark_checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1024]"):
        try:
            common.shared_dir(Session(spark_master=master))
        except ValueError:
            continue
        raise AssertionError(master)
    assert common.shared_dir(Session(spark_master="local[4]")).startswith("file://")
