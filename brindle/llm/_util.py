"""What the operators of this subpackage share: the cluster's shared folder, tables cut from their lineage, components of a link table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset (tests) a temporary folder is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="brindle-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/brindle/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet under the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done and stored: it does once no event or plan refers to them."""
    sc = spark.sparkContext
    for _ in range(2):  # what the first pass finalises may still refer to a plan
        sc._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        sc._jvm.System.gc()
        time.sleep(0.5)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/brindle/" in folder and root.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str | Column) -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def slices(batches, text_at: int, most_chars: int = 1 << 20):
    """(slice, its texts) of Arrow batches, of most_chars characters or one text, so what a task holds of tokens stays bounded. Nulls: empty."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            begin = held = 0
            for k, t in enumerate(texts):
                if k > begin and held + len(t) > most_chars:
                    yield batch.slice(begin, k - begin), texts[begin:k]
                    begin, held = k, 0
                held += len(t)
            if begin < len(texts):
                yield batch.slice(begin), texts[begin:]


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, hottest: int = 1000) -> DataFrame:
    """rows joined (inner) with facts on keys; facts has one row a key and, in `count`, its number of rows (or less).

    The keys that hold more than 1 / hottest of all rows, so fewer than `hottest`, are told to the tasks by their hashes and joined by
    broadcast (with the few keys whose hash is the same), so no task holds a hot one.
    """
    most = max(rows.count() // hottest, 100)
    key = F.xxhash64(*keys)
    hot = [r["h"] for r in facts.where(F.col(count) > most).select(key.alias("h")).distinct().collect()]
    if not hot:
        return rows.join(facts.hint("merge"), keys)
    apart = rows.where(key.isin(hot)).join(F.broadcast(facts.where(key.isin(hot))), keys)
    return apart.unionByName(rows.where(~key.isin(hot)).join(facts.where(~key.isin(hot)).hint("merge"), keys))


def more_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b): only the components that they join are worked on."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = stored(both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "joined")
    new = components(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    ids = labels.unionAll(both.select("a", "ca")).unionAll(both.select("b", "cb")).distinct()
    new = new.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return stored(ids.join(new, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id of links (a, b) the smallest id reachable.

    Each round takes the smallest label among the neighbours and then jumps to the label of the label, so the number of rounds
    grows with the logarithm of the diameter. Labels stay distributed; a join of edges with labels may be split when a hub is hot.
    """
    edges = links.select(F.col("a").alias("s"), F.col("b").alias("t")).where("s <> t").distinct()
    edges = stored(edges.unionAll(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))), "edges")
    labels = stored(edges.groupBy(F.col("s").alias("id")).agg(F.least(F.min("t"), F.col("id")).alias("l")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("s") == F.col("id")).groupBy(F.col("t").alias("id")).agg(F.min("l").alias("m"))
        step = labels.join(near, "id").select("id", "l", F.least("l", "m").alias("n"))
        jump = step.select(F.col("id").alias("j"), F.col("n").alias("nn"))
        # a label is an id of the table itself, so each row finds its jump
        after = stored(step.join(jump, F.col("n") == F.col("j")).select("id", F.least("n", "nn").alias("l"), (F.least("n", "nn") < F.col("l")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        drop_stored(labels)
        labels = after.select("id", "l")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    drop_stored(edges)
    return labels.select("id", F.col("l").alias("component"))
