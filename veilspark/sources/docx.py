"""Word documents: reading blocks and writing redacted copies, with the standard library's zip and XML.

A file is parsed by one task, so block_index is a counter there. Traversal: body paragraphs, top-level tables cell by cell
(a merged cell once), then header and footer of each section (a section without its own has that of the section before).
"""

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilspark.model import BLOCKS

#: Names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAX_UPLOAD = 5 * 1024 * 1024


class Package:
    """A document's parts and the paragraphs in them."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())
        self.trees: dict[str, ET.Element] = {}
        for _, (prefix, uri) in ET.iterparse(io.BytesIO(self.zip.read("word/document.xml")), events=["start-ns"]):
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        self.targets = {}
        if "word/_rels/document.xml.rels" in self.names:
            for r in ET.fromstring(self.zip.read("word/_rels/document.xml.rels")).iter(f"{PKG}Relationship"):
                self.targets[r.get("Id")] = "word/" + r.get("Target", "").removeprefix("/word/")
        self.styles = {}
        if "word/styles.xml" in self.names:
            for s in ET.fromstring(self.zip.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                self.styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
                if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") == "1":
                    self.styles[None] = self.styles[s.get(f"{W}styleId")]

    def tree(self, part: str) -> ET.Element:
        if part not in self.trees:
            self.trees[part] = ET.fromstring(self.zip.read(part))
        return self.trees[part]

    def tables(self) -> list[list[list[tuple[ET.Element, bool]]]]:
        """Cells (element, whether it continues one met before) of each row of each top-level table, by grid column."""
        out = []
        for table in self.tree("word/document.xml").find(f"{W}body").findall(f"{W}tbl"):
            above: list[ET.Element] = []
            rows = []
            for row in table.findall(f"{W}tr"):
                cells: list[tuple[ET.Element, bool]] = []
                for cell in row.findall(f"{W}tc"):
                    props = cell.find(f"{W}tcPr")
                    span = props.find(f"{W}gridSpan") if props is not None else None
                    merge = props.find(f"{W}vMerge") if props is not None else None
                    goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
                    shown, old = cell, False
                    if goes_on and len(cells) < len(above):
                        shown, old = above[len(cells)], True
                    for k in range(int(span.get(f"{W}val", "1")) if span is not None else 1):
                        cells.append((shown, old or k > 0))
                above = [c for c, _ in cells]
                rows.append(cells)
            out.append(rows)
        return out

    def paragraphs(self) -> Iterator[tuple[str, str, ET.Element]]:
        """(location, block type, element) of all paragraphs."""
        body = self.tree("word/document.xml").find(f"{W}body")
        for i, p in enumerate(body.findall(f"{W}p")):
            yield f"body.p_{i}", "paragraph", p
        for t, rows in enumerate(self.tables()):
            for r, cells in enumerate(rows):
                for c, (cell, old) in enumerate(cells):
                    if not old:
                        for i, p in enumerate(cell.findall(f"{W}p")):
                            yield f"table_{t}.row_{r}.cell_{c}.p_{i}", "table_cell", p
        last: dict[str, str] = {}
        for s, section in enumerate(body.iter(f"{W}sectPr")):
            for kind in ("header", "footer"):
                for ref in section.findall(f"{W}{kind}Reference"):
                    if ref.get(f"{W}type", "default") == "default" and self.targets.get(ref.get(f"{REL}id")) in self.names:
                        last[kind] = self.targets[ref.get(f"{REL}id")]
                if kind in last:
                    for i, p in enumerate(self.tree(last[kind]).findall(f"{W}p")):
                        yield f"section_{s}.{kind}.p_{i}", kind, p

    def style(self, paragraph: ET.Element) -> str | None:
        own = paragraph.find(f"{W}pPr/{W}pStyle")
        return self.styles.get(own.get(f"{W}val") if own is not None else None)

    def saved(self) -> bytes:
        """The package with changed parts; other members as they were."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.zip.infolist():
                part = self.trees.get(item.filename)
                z.writestr(item, ET.tostring(part, encoding="UTF-8", xml_declaration=True) if part is not None else self.zip.read(item.filename))
        return out.getvalue()


def pieces(paragraph: ET.Element) -> list[tuple[ET.Element, str]]:
    """Text-bearing elements of a paragraph's runs (links included) with their text: tabs and breaks are one character."""
    out = []
    for run in paragraph.iter(f"{W}r"):
        for x in run:
            if x.tag == f"{W}t":
                out.append((x, x.text or ""))
            elif x.tag in (f"{W}tab", f"{W}ptab"):
                out.append((x, "\t"))
            elif x.tag in (f"{W}br", f"{W}cr"):
                out.append((x, "\n"))
            elif x.tag == f"{W}noBreakHyphen":
                out.append((x, "-"))
    return out


def text_of(paragraph: ET.Element) -> str:
    return "".join(t for _, t in pieces(paragraph))


def replace(paragraph: ET.Element, start: int, end: int, value: str) -> None:
    """Puts value in place of [start, end): the first run touched gets it, so its style holds; later ones lose their part."""
    at, first = 0, True
    for x, t in pieces(paragraph):
        a, b = max(start - at, 0), min(end - at, len(t))
        if a < b:
            new = t[:a] + (value if first else "") + t[b:]
            first = False
            if x.tag != f"{W}t":
                x.tag = f"{W}t"
                x.attrib.clear()
            x.text = new
            x.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        at += len(t)


def blocks_of(doc_id: str, raw: bytes) -> Iterator[tuple]:
    """Rows of BLOCKS of one document."""
    package, n = Package(raw), 0
    for location, kind, p in package.paragraphs():
        text = text_of(p)
        if text.strip():
            yield doc_id, n, kind, location, text, package.style(p)
            n += 1


def redacted_copy(raw: bytes, edits: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """The document with edits (start, end, value) applied to blocks by index, from right to left."""
    package, n = Package(raw), 0
    done = set()
    for _, _, p in package.paragraphs():
        if text_of(p).strip():
            for start, end, value in sorted(edits.get(n, []), reverse=True) if id(p) not in done else []:
                replace(p, start, end, value)
            done.add(id(p))
            n += 1
    return package.saved()


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of paths that is there, on any file system that Spark reads; the last if none is, for files() to report."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    return paths[-1]


def files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, length, content of the .docx files at path, whatever the case of the suffix; max_bytes leaves out larger ones.

    Raises FileNotFoundError for a path that is not there, ValueError for a file of another kind.
    """
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")[2] if "." in path.rstrip("/").rpartition("/")[2] else ""
    if suffix and suffix.lower() != "docx" and "*" not in path:
        raise ValueError(f"Expected a DOCX file, got: .{suffix}")
    try:
        rows = spark.read.format("binaryFile").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"DOCX file not found: {path}") from e
        raise
    rows = rows.filter(F.lower("path").endswith(".docx")).select("path", "length", "content")
    return rows if max_bytes is None else rows.filter(F.col("length") <= max_bytes)


def read_blocks(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Blocks of all documents at path, on any file system that Spark reads; doc_id is the file's path."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for doc, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(blocks_of(doc, raw)), columns=BLOCKS.names)

    return files(spark, path, max_bytes).select("path", "content").mapInPandas(parse, BLOCKS)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, table, row, cell, text of all cells, merged ones repeated and empty ones included; texts are stripped."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (doc, t, r, c, "\n".join(text_of(p) for p in cell.findall(f"{W}p")).strip())
                for doc, raw in zip(pdf["path"], pdf["content"], strict=True)
                for t, table in enumerate(Package(raw).tables())
                for r, cells in enumerate(table)
                for c, (cell, _) in enumerate(cells)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "table", "row", "cell", "text"])

    return files(spark, path).select("path", "content").mapInPandas(parse, "doc_id string, table int, row int, cell int, text string")


def structure(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tables, body_paragraphs of each document."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc, raw in zip(pdf["path"], pdf["content"], strict=True):
                body = Package(raw).tree("word/document.xml").find(f"{W}body")
                rows.append((doc, len(body.findall(f"{W}tbl")), len(body.findall(f"{W}p"))))
            yield pd.DataFrame(rows, columns=["doc_id", "tables", "body_paragraphs"])

    return files(spark, path).select("path", "content").mapInPandas(parse, "doc_id string, tables int, body_paragraphs int")


def redacted_files(spark: SparkSession, path: str, edits: DataFrame) -> DataFrame:
    """path, content: the documents at path with edits(doc_id, block_index, start, end, replacement) applied.

    Each document is rewritten by one task; its edits come to it by an equi-join on the path.
    """
    by_doc = edits.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("block_index", "start", "end", "replacement")).alias("edits"))

    def write(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, raw, own in zip(pdf["path"], pdf["content"], pdf["edits"], strict=True):
                by_block: dict[int, list] = {}
                for e in own if own is not None else []:
                    by_block.setdefault(int(e["block_index"]), []).append((int(e["start"]), int(e["end"]), e["replacement"]))
                out.append((doc, redacted_copy(raw, by_block)))
            yield pd.DataFrame(out, columns=["path", "content"])

    rows = files(spark, path).select("path", "content").join(by_doc, "path", "left")
    return rows.mapInPandas(write, "path string, content binary")


def save(documents: DataFrame, folder: str, prefix: str = "REDACTED_") -> DataFrame:
    """Writes documents(path, content) into a folder of any file system that pyarrow knows; returns (path, target)."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            targets = [f"{base}/{prefix}{p.rpartition('/')[2]}" for p in pdf["path"]]
            for t, raw in zip(targets, pdf["content"], strict=True):
                with store.open_output_stream(t) as f:
                    f.write(raw)
            yield pd.DataFrame({"path": pdf["path"], "target": targets})

    return documents.mapInPandas(write, "path string, target string")


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DocxSource(DataSource):
    """spark.read.format("docx").load(folder or file) for files that every node can open; register with register()."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return DocxReader(self.options["path"])


class DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"DOCX file not found: {self.path}")
        if info.type == fs.FileType.File and not base.lower().endswith(".docx"):
            raise ValueError(f"Expected a DOCX file, got: {base}")
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return [OneFile(x.path) for x in found if x.path.lower().endswith(".docx")]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as f:
            yield from blocks_of(partition.path, f.read())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)
