"""Word-processor files as paragraphs: a data source reads the containers, windows do the rest."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import numbering
from ..tables import stored
from . import files

BODY, NUMBERING = "word/document.xml", "word/numbering.xml"
RAW = "doc string, seq long, text string, style string, ilvl string, num_id string, error string"


def raw_paragraphs(content: bytes) -> list[tuple[str, str | None, str | None, str | None]]:
    """(text, style, ilvl, num_id) of each paragraph that has a start and an end tag; ValueError if it can't be read.

    A paragraph inside another one begins anew, and what follows its end in the outer one is lost.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            body = z.read(BODY)
            lists = z.read(NUMBERING) if NUMBERING in names else None
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError, OSError) as e:
        raise ValueError(f"no document: {e}") from e
    out: list[tuple[str, str | None, str | None, str | None]] = []
    now: dict = {"text": None}

    def value(attributes: dict) -> str | None:
        return attributes.get("w:val")

    def start(name: str, attributes: dict) -> None:
        if name == "w:p":
            now.update(text=[], style=None, ilvl=None, num_id=None, in_list=False)
        elif name == "w:numPr":
            now["in_list"] = True
        elif name == "w:pStyle":
            now["style"] = value(attributes)
        elif name in ("w:ilvl", "w:numId") and now.get("in_list"):
            now["ilvl" if name == "w:ilvl" else "num_id"] = value(attributes)

    def end(name: str) -> None:
        if name == "w:numPr":
            now["in_list"] = False
        elif name == "w:p" and now["text"] is not None:
            out.append(("".join(now["text"]), now["style"], now["ilvl"], now["num_id"]))
            now["text"] = None

    def text(data: str) -> None:
        if now["text"] is not None:
            now["text"].append(data)

    reader = expat.ParserCreate()
    reader.buffer_text = True
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, end, text
    try:
        # An element without content is no blank paragraph; expat tells it by its end at the place of its start.
        reader.Parse(_without_empty_paragraphs(body), True)
        if lists is not None:
            expat.ParserCreate().Parse(lists, True)
    except expat.ExpatError as e:
        raise ValueError(f"malformed XML: {e}") from e
    return out


def _without_empty_paragraphs(body: bytes) -> bytes:
    return re.sub(rb"<w:p(?:\s[^<>]*)?/>", b"", body)


def read_raw(contents: DataFrame) -> DataFrame:
    """(doc, content) -> ``RAW`` rows; a file that can't be read has one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((doc.as_py(), content.as_py() or b"") for batch in batches for doc, content in zip(batch.column(0), batch.column(1), strict=True))

    return contents.select("doc", "content").mapInArrow(run, RAW)


#: Rows and characters of text after which a batch of raw rows is full; a file's rows are never parted.
FULL_ROWS, FULL_CHARS = 4096, 1 << 22


def _batched(found: Iterable[tuple[str | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Raw rows of files, those of many small ones in one batch."""
    rows, chars = [], 0
    for doc, content in found:
        try:
            mine = [(doc, i, *p, None) for i, p in enumerate(raw_paragraphs(content))]
        except ValueError as e:
            mine = [(doc, 0, None, None, None, None, str(e)[:200])]
        rows += mine
        chars += sum(len(r[2] or "") for r in mine)
        if len(rows) >= FULL_ROWS or chars >= FULL_CHARS:
            yield _batch(rows)
            rows, chars = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc", "seq", "text", "style", "ilvl", "num_id", "error"]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


#: Characters that XML 1.0 does not know.
_NO_XML = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _escaped(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), *marks):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _element() -> Column:
    """The XML of a paragraph's row."""
    value = lambda name: _escaped(F.col(name), (('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;")))
    tag = lambda tag, name: F.coalesce(F.concat(F.lit(f'<w:{tag} w:val="'), value(name), F.lit('"/>')), F.lit(""))
    listed = F.when(F.col("ilvl").isNull() & F.col("num_id").isNull(), "").otherwise(F.concat(F.lit("<w:numPr>"), tag("ilvl", "ilvl"), tag("numId", "num_id"), F.lit("</w:numPr>")))
    inner = F.concat(tag("pStyle", "style"), listed)
    marks = F.when(inner == "", "").otherwise(F.concat(F.lit("<w:pPr>"), inner, F.lit("</w:pPr>")))
    text = F.coalesce(_escaped(F.col("text"), ()), F.lit(""))
    return F.regexp_replace(F.concat(F.lit("<w:p>"), marks, F.lit("<w:r><w:t>"), text, F.lit("</w:t></w:r></w:p>")), _NO_XML, "")


def _dealt(raw: DataFrame) -> DataFrame:
    """doc, xml of each paragraph: a document's lie in one partition, one after another in their order."""
    return raw.select("doc", "seq", _element().alias("xml")).repartition("doc").sortWithinPartitions("doc", "seq", "xml").select("doc", "xml")


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    """Batches of ``_dealt`` rows -> each document and its file's bytes; the texts of one document are held at a time, and those of a batch as Arrow has them."""
    now, held = None, []
    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        xml, first = batch.column(1), 0
        for doc, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if held and doc != now:
                yield now, _container(held)
                held = []
            now = doc
            held += xml.slice(first, end - first).to_pylist()
            first = end
    if held:
        yield now, _container(held)


def _container(elements: list[str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(BODY, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="w"><w:body>{"".join(elements)}</w:body></w:document>')
    return data.getvalue()


#: Bytes of files after which a batch of them is full.
FULL_BYTES = 1 << 22


def containers(raw: DataFrame) -> DataFrame:
    """doc, seq, text, style, ilvl, num_id -> doc, content: a file's bytes for each document, for ``read_raw`` to read.

    A null text is a blank paragraph; characters that XML does not know are left out. Paragraphs are dealt by document and sorted, so that a task
    holds those of one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = lambda held: pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["doc", "content"])
        held, n = [], 0
        for doc, content in _made(batches):
            held.append((doc, content))
            n += len(content)
            if n >= FULL_BYTES:
                yield files(held)
                held, n = [], 0
        if held:
            yield files(held)

    return _dealt(raw).mapInArrow(run, "doc string, content binary")


def write_documents(raw: DataFrame, folder: str) -> int:
    """``containers`` as files ``doc`` below a folder, each written by the task that makes it as soon as it is made; returns how many."""
    return _written(_dealt(raw), folder, _made)


def write_files(contents: DataFrame, folder: str) -> int:
    """Write (doc, content) rows as files ``doc`` below a folder, by the tasks that have them; returns how many.

    A file has its name when it is whole; a task that runs again writes the same bytes under it.
    """
    return _written(contents.select("doc", "content"), folder, _given)


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    return ((doc.as_py(), content.as_py()) for batch in batches for doc, content in zip(batch.column(0), batch.column(1), strict=True))


#: Bytes of rows after which a batch that a writing task gets is full, where the session has Spark's own 64 MB: paragraphs may be long.
GIVEN_BYTES = 1 << 22
_GIVEN, _SPARKS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _written(rows: DataFrame, folder: str, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str | None, bytes]]]) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        folders, n = set(), 0
        for doc, content in made(batches):
            path = f"{root}/{doc}"
            if (above := path.rpartition("/")[0]) not in folders:
                store.create_dir(above, recursive=True)
                folders.add(above)
            draft = f"{path}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(content)
            store.move(draft, path)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    conf = rows.sparkSession.conf
    if own := conf.get(_GIVEN) == _SPARKS:
        conf.set(_GIVEN, str(GIVEN_BYTES))
    try:
        return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        if own:
            conf.unset(_GIVEN)


def structured(raw: DataFrame) -> DataFrame:
    """Raw rows -> doc, position, text, line_breaks_after."""
    kept = numbering.kept_with_breaks(raw.where("error is null"))
    return numbering.sections(numbering.numbered(numbering.classified(kept)))


#: Files that one task of the data source opens, about; paths that are named in one read, at most.
FILES_PER_TASK, MOST_PATHS = 64, 50_000
#: Files that one task opens of a table of paths, about; tasks are fewer than the shuffle's partitions only where a task would have under ``LEAST_LISTED`` files.
LISTED_PER_TASK, LEAST_LISTED = 1000, 16


def _content(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return b""  # it went since it was listed: an error like that of a broken file


@dataclass
class _Files(InputPartition):
    """Files that one task opens."""

    value: list[tuple[str, str]]  # (name, path)


class DocxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "").removeprefix("file://").rstrip("/")
        self.names = json.loads(options["names"]) if "names" in options else None
        self.per_task = int(options.get("filespertask", FILES_PER_TASK))

    def partitions(self) -> list[_Files]:
        names = self.names if self.names is not None else sorted(files.documents_below(self.root))
        return [_Files([(n, f"{self.root}/{n}") for n in names[k : k + self.per_task]]) for k in range(0, len(names), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _batched((name, _content(path)) for name, path in partition.value)


class DocxSource(DataSource):
    """Word-processor files as ``RAW`` rows, for ``spark.read.format("docx").load(folder)``.

    Partitions are lists of files, and a file that is not in one is never opened. Option ``names``: a JSON list of paths below the
    folder, in place of all documents that lie there (excluded folders and those too deep are not entered); ``filesPerTask``. The folder is one that
    driver and executors can open; files elsewhere are read through ``read_named``.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(self.options)


def read_named(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``RAW`` rows of these files below a folder, ``MOST_PATHS`` at most; no other file is opened.

    Files on local disks are read by the data source, others by Spark's reader of whole files, given their paths.
    """
    if len(names) > MOST_PATHS:
        raise ValueError(f"{len(names)} paths in one read; at most {MOST_PATHS}")
    if not names:
        return spark.createDataFrame([], RAW)
    if files.is_local(folder):
        spark.dataSource.register(DocxSource)
        return spark.read.format("docx").option("names", json.dumps(names)).load(folder)
    root = folder.rstrip("/")
    plain = [f"{root}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", n) for n in names]
    found = spark.read.format("binaryFile").load(plain).select(files.below(F.col("path"), root).alias("doc"), "content")
    return read_raw(found)


def read_listed(spark: SparkSession, folder: str, paths: DataFrame, n: int) -> DataFrame:
    """``RAW`` rows of the ``n`` files in a table of paths below a folder that driver and executors can open. Tasks read the paths: the driver sees none."""
    root = folder.removeprefix("file://").rstrip("/")
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_LISTED), -(-n // LISTED_PER_TASK), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((name, _content(f"{root}/{name}")) for batch in batches for name in batch.column(0).to_pylist())

    return paths.select("path").repartition(parts).mapInArrow(run, RAW)


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All documents below a folder: (paragraphs, errors). Contents are joined with nothing: what is no document is not opened."""
    if files.is_local(folder):
        path = F.col("path")
        # Written, so that both results are of one listing.
        found = stored(files.walk(spark, folder).where(files.is_document(path) & ~files.in_excluded_folder(path)).select("path"), "documents-found")
        raw = read_listed(spark, folder, found, found.count())
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(files.below(F.col("path"), folder.rstrip("/")).alias("doc"), "content")
        doc = F.col("doc")
        raw = read_raw(found.where(files.is_document(doc) & ~files.in_excluded_folder(doc) & (F.size(F.split(doc, "/")) <= files.MAX_DEPTH)))
    return structured(raw), raw.where("error is not null").select("doc", "error")
