"""Text sources: lines, chunks, word vectors, merge files, documents of several formats."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.functions import vector as V
from hyperspark.plans.runtime import ship


def read_lines(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """``(value)``: lines of text files without line ends, of at least ``least`` characters."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value")).where(F.length("value") >= least)


def ingest_lines(rows: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """``(key, line_no, line)`` of the lines of a text column, of at least ``least`` characters."""
    lines = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("i", "line"))
    return lines.where(F.length("line") >= least).select(key, (F.col("i") + 1).alias("line_no"), "line")


def chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(key, chunk_no, chunk)``: consecutive pieces of ``size`` characters; null and empty texts give none."""
    full = rows.where(F.length(text) > 0)
    numbers = F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size))).alias("chunk_no")
    return full.select(key, text, numbers).select(key, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.substring(F.col(text), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def parse_word_vectors(lines: DataFrame, dim: int, column: str = "value") -> DataFrame:
    """``(word, v)`` of lines ``word f1 … f_dim``, vectors of unit length; malformed lines are left out."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    numbers = F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("double"))
    rows = lines.where(F.size(parts) == dim + 1).select(parts[0].alias("word"), numbers.alias("v"))
    return rows.where(~F.exists("v", lambda x: x.isNull())).select("word", V.normalise(F.col("v")).alias("v"))


def read_binary_vectors(spark: SparkSession, path: str, dim: int = 300) -> DataFrame:
    """``(word, v)`` of binary word-vector files: a header ``rows dim``, then ``word`` and ``dim`` little-endian floats; others give no rows."""
    ship(spark)

    def parse(frames):
        for frame in frames:
            words, vectors = [], []
            for content in frame["content"]:
                end = content.find(b"\n")
                head = content[:end].split()
                if len(head) != 2 or int(head[1]) != dim:
                    continue
                at = end + 1
                for _ in range(int(head[0])):
                    stop = content.find(b" ", at)
                    if stop < 0 or stop + 1 + 4 * dim > len(content):
                        break
                    v = np.frombuffer(content, "<f4", dim, stop + 1).astype(float)
                    words.append(content[at:stop].strip().decode("utf-8", "replace"))
                    vectors.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
                    at = stop + 1 + 4 * dim
            yield pd.DataFrame({"word": words, "v": vectors})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "word string, v array<double>")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)`` of a merge file: one pair a line in order of rank, after a first line that is skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    pair = F.split("line", " ")
    return lines.where((F.col("i") > 0) & (F.size(pair) == 2)).select((F.col("i") - 1).alias("rank"), pair[0].alias("left"), pair[1].alias("right"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a JSON object of token numbers."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, bigint>").alias("m"))
    return one.select(F.explode("m").alias("token", "id"))


def extract(content: bytes, suffix: str) -> str:
    """Text of a document by its suffix: html, htm, xml, md, docx, epub, pdf (if a reader is installed), else plain."""
    if suffix in ("docx", "epub"):
        try:
            with zipfile.ZipFile(BytesIO(content)) as z:
                if suffix == "docx":
                    return re.sub(r"<[^>]+>", " ", z.read("word/document.xml").decode("utf-8", "replace"))
                return "\n".join(page_text(z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith((".html", ".htm", ".xhtml")))
        except (zipfile.BadZipFile, KeyError):
            return ""
    if suffix == "pdf":
        try:
            from pdfminer.high_level import extract_text
        except ImportError:
            return ""
        return extract_text(BytesIO(content))
    text = content.decode("utf-8", "replace")
    return page_text(text) if suffix in ("html", "htm", "xml") else text


def page_text(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", html)
    return " ".join(re.sub(r"&[a-z]+;", " ", re.sub(r"<[^>]+>", " ", html)).split())


def read_documents(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = ("pdf", "txt", "html", "md", "docx", "epub")) -> DataFrame:
    """``(path, text)`` of the documents of a folder; Markdown is stripped of its marks."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))

    @F.pandas_udf("string")
    def text_of(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([extract(bytes(c), k) for c, k in zip(contents, kinds)])

    found = files.where(suffix.isin(*suffixes)).select("path", text_of("content", suffix).alias("text"), suffix.alias("suffix"))
    return found.select("path", F.when(F.col("suffix") == "md", T.markdown_text(F.col("text"))).otherwise(F.col("text")).alias("text"))
