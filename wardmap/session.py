"""Session helpers: builder for local runs and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What results depend on; plans are left to Spark's defaults (adaptive execution with skewed joins split).
RESULT_SETTINGS = {"spark.sql.session.timeZone": "UTC"}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "wardmap") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_settings(spark: SparkSession) -> None:
    """Set what results depend on, on a session somebody else built."""
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables and stream checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where that is
    unset, in a local run, a scratch folder is made and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="wardmap-")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders handed out since the last ``drop_work``.
_HANDED_OUT: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """Unused folder for an intermediate table or a stream."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


#: Catalogue tables whose files are in these folders.
_TABLES: list[str] = []


def new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """Unused name of a catalogue table and the folder for its files."""
    path = new_path(spark, name)
    _TABLES.append("work_" + path.rsplit("/", 1)[1].replace("-", "_"))
    return _TABLES[-1], path


def drop_work(spark: SparkSession) -> int:
    """Delete the intermediate tables of the queries run so far; how many folders that were.

    To be called once their results are written: a result not yet computed still reads them.
    """
    dropped = 0
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _HANDED_OUT:
        dropped += delete_folder(spark, _HANDED_OUT.pop())
    return dropped


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder, wherever Spark stores it; False if there was none."""
    path, files = _file_system(spark, folder)
    return bool(files.delete(path, True))


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if it does not exist."""
    path, files = _file_system(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results that several branches of a query use. They survive lost executors, and
    the readers get Parquet pruning and true sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
