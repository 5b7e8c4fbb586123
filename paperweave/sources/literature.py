"""Literature as a source: pulls by month and query, validation, pages.

``LiteratureSource`` is a Python data source whose client is injected; the one here answers from a table of articles, so that pulls
can be tested without a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ARTICLE = "_id string, title string, publication_date string, abstract string, journal string, doi string, authors array<string>, issn string"
#: Articles that one search returns at most; what a window has beyond is asked for from there on.
MOST_HITS = 9999


def matches(text: Column, terms: list[str]) -> Column:
    """Any of the terms in a text, whatever the case."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t.lower()))
    return out


def valid_articles(fetched: DataFrame) -> DataFrame:
    """Articles with title, year and abstract, stripped; the other fields may be missing."""
    out = fetched
    for c in ("title", "publication_date", "abstract"):
        out = out.withColumn(c, F.nullif(F.btrim(c), F.lit("")))
    return out.dropna(subset=["_id", "title", "publication_date", "abstract"])


def rejected_articles(fetched: DataFrame) -> DataFrame:
    """The others, with what they lack."""
    missing = [F.when(F.col(c).isNull() | (F.btrim(c) == ""), F.lit(c)) for c in ("_id", "title", "publication_date", "abstract")]
    return fetched.withColumn("missing", F.array_compact(F.array(*missing))).where(F.size("missing") > 0)


class Window(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class LiteratureSource(DataSource):
    """spark.read.format("literature").option("client", "module:function").option("windows", "2020-01-01/2020-02-01,...").load()

    The client takes (start, end, first, most) and yields at most so many rows of ``ARTICLE`` from the first on, in an order that stays;
    each window is a partition, and is read page by page to its end. With an option "source" the client gets that too, by this name.

    As a stream, the offset is the number of windows that are done: a batch reads those that its checkpoint has not yet committed, so a run
    that was stopped goes on after its last finished batch. The list of windows may grow at its end between runs, and not otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.client, self.windows = options["client"], [w for w in options.get("windows", "").split(",") if w]
        self.more = {"source": options["source"]} if "source" in options else {}

    def partitions(self) -> list[InputPartition]:
        return [Window(*w.split("/")) for w in self.windows]

    def read(self, window: Window) -> Iterator[tuple]:
        import importlib

        module, _, name = self.client.partition(":")
        client: Callable = getattr(importlib.import_module(module), name)
        at = 0
        while True:
            page = list(client(window.start, window.end, at, MOST_HITS, **self.more))
            yield from map(tuple, page)
            at += len(page)
            if len(page) < MOST_HITS:
                return


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.batch = _Reader(options)

    def initialOffset(self) -> dict:
        return {"windows": 0}

    def latestOffset(self) -> dict:
        return {"windows": len(self.batch.windows)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["windows"] > len(self.batch.windows):
            raise ValueError("the checkpoint has windows that the list has not")
        return self.batch.partitions()[start["windows"] : end["windows"]]

    def read(self, window: Window) -> Iterator[tuple]:
        return self.batch.read(window)

    def commit(self, end: dict) -> None:
        pass  # the stream's checkpoint is the log of finished windows


def stub_client(start: str, end: str, first: int = 0, most: int = MOST_HITS) -> Iterator[tuple]:
    """Three articles a window, made from its start."""
    for i in range(first, min(3, first + most)):
        yield (f"{start}-{i}", f"Title {i}", start[:4], f"Abstract {i} of {start}.", "Journal", None, ["A. Author"], None)


def table_client(start: str, end: str, first: int = 0, most: int = MOST_HITS, source: str = "") -> Iterator[tuple]:
    """Articles of the window [start, end), as they stand in the Parquet table of orders at ``source``, a URI or path.

    Row groups are read one at a time, and only those whose dates meet the window, up to the last article asked for.
    """
    from datetime import datetime

    import pyarrow.dataset as pads
    from pyarrow import fs as pafs

    files, path = pafs.FileSystem.from_uri(source if "://" in source or source.startswith("file:") else f"file://{source}")
    table = pads.dataset(path, filesystem=files, format="parquet")
    day = pads.field("o_orderdate")
    inside = (day >= datetime.fromisoformat(start)) & (day < datetime.fromisoformat(end))
    columns = ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    for batch in table.scanner(columns=columns, filter=inside, batch_size=8192, batch_readahead=0, fragment_readahead=0, use_threads=False).to_batches():
        page = batch.slice(first, most)
        first, most = max(0, first - batch.num_rows), most - page.num_rows
        for r in page.to_pylist():
            yield (str(r["o_orderkey"]), r["o_orderpriority"], r["o_orderdate"].date().isoformat(), f"{r['o_orderstatus']} {r['o_orderpriority']}", None, None, None, None)
        if not most:
            return


def _windows(windows: DataFrame) -> str:
    """The windows as an option; they are calendar steps, a dozen a year."""
    return ",".join(f"{r.start}/{r.end}" for r in windows.orderBy("start").collect())


def pull(spark: SparkSession, windows: DataFrame, client: str, **options: str) -> DataFrame:
    """Valid articles of all windows (start, end)."""
    spark.dataSource.register(LiteratureSource)
    return valid_articles(spark.read.format("literature").options(client=client, windows=_windows(windows), **options).load())


def pull_stream(spark: SparkSession, windows: DataFrame, client: str, **options: str) -> DataFrame:
    """The same as a stream of the windows that its checkpoint has not finished."""
    spark.dataSource.register(LiteratureSource)
    return valid_articles(spark.readStream.format("literature").options(client=client, windows=_windows(windows), **options).load())
