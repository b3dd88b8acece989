"""Marked-up source files: one file is one book. Decoding, header, body, and a log line for each file.

A body is read in one pass over its tags. Four tags mean something (page, blank page, heading, footnote); what stands
between them is text, a block for each line; any other tag is taken out and its content flows on. A heading, footnote
or blank page may span lines, a page label may not.

A file that cannot be read gives a row with ok false, the stage and a message; it never fails the job.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .books import BOOK

# Fixed values of the format: encodings in the order they are tried, tags, metadata keys.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1256")
BODY, TITLE, AUTHOR = "الكتاب", "اسم الكتاب", "اسم المؤلف"
KINDS = {"صفحة": "page", "صفحة فارغة": "blank", "فهرس الموضوعات": "heading", "هامش": "footnotes"}
METADATA = {
    "سنة الوفاة": "authorDeath", "مجموعة": "collection", "جزء": "volume", "تحقيق": "editor", "طبعة": "edition", "سنة الطبع": "publicationYear", "مطبعة": "printer",
    "الناشر": "publisher", "ردمك": "isbn", "ملاحظات الهوية": "notes", "ملف مرفق": "attachedFile", "تطابق الصفحات": "pageMatched", "التاريخ": "sourceDate", "موثوق": "trusted",
}
#: Keys whose value is a boolean, and the word that means true.
BOOLEANS, TRUE = {"pageMatched", "trusted"}, "1"
TAG = re.compile(r"<[^\S\n]*(/?)[^\S\n]*([^<>\n]+?)[^\S\n]*>")
HEADER = re.compile(r"<\s*([^<>/]+?)\s*>\s*(.*?)\s*<\s*/\s*\1\s*>")
CROSS_REFERENCE = re.compile(r" ?<\s*/?\s*ارتباط\s*=\s*\d+\s*> ?")
#: Fixed value: a label that is a number, with or without a note in brackets.
NUMERIC = re.compile(r"\d+(\s*\(.*\))?$")


class SourceError(ValueError):
    def __init__(self, stage: str, message: str):
        super().__init__(message)
        self.stage = stage


def decode(raw: bytes) -> str:
    """Strict decoding in the fixed order; cross-reference tags become a space."""
    for name in ENCODINGS:
        try:
            return CROSS_REFERENCE.sub(" ", "\n".join(bytes(raw).decode(name).splitlines()))
        except UnicodeDecodeError:
            pass
    raise SourceError("decode", "none of the encodings fits: " + ", ".join(ENCODINGS))


def header(text: str) -> tuple[dict[str, str], str]:
    """(tag -> value, body). The first line is a checksum."""
    found: dict[str, str] = {}
    rest = text.split("\n")
    for i, line in enumerate(rest[1:], 1):
        tag = TAG.fullmatch(line.strip())
        if tag and not tag[1] and tag[2] == BODY:
            return found, "\n".join(rest[i + 1 :])
        pair = HEADER.fullmatch(line.strip())
        if pair:
            found[pair[1]] = pair[2]
    raise SourceError("header", "no body")


def events(body: str):
    """(kind, text) in order: text lines, and the content of the tags that mean something."""
    at, pos = 0, 0
    while True:
        tag = TAG.search(body, pos)
        for line in body[at : tag.start() if tag else len(body)].split("\n"):
            if line.strip():
                yield "text", line.strip()
        if not tag:
            return
        at = pos = tag.end()
        name = " ".join(tag[2].split())
        kind = None if tag[1] else KINDS.get(name)
        if kind is None:
            continue
        close = next((t for t in TAG.finditer(body, pos) if t[1] and " ".join(t[2].split()) == name), None)
        if kind == "page" and (close is None or "\n" in body[pos : close.start()]):
            continue
        if close is None:
            raise SourceError("body", f"a {kind} is never closed")
        lines = [" ".join(TAG.sub(" ", x).split()) for x in body[pos : close.start()].split("\n")]
        inner = lines[1:-1] if len(lines) > 1 else []
        ends = (lines[:1], lines[-1:] if len(lines) > 1 else [])
        yield kind, "\n".join([x for x in ends[0] if x] + inner + [x for x in ends[1] if x])
        at = pos = close.end()


def printed(label: str) -> int | None:
    """The number that leads a label, else the one that ends it."""
    m = re.match(r"\s*(\d+)", label) or re.search(r"(\d+)\s*$", label)
    return int(m[1]) if m else None


def front_pages(labels: list[str]) -> int:
    """How many pages come before the main part: those up to the first fall of the printed numbers; else all if any label is words, else none."""
    numbers = pd.Series([printed(x) for x in labels], dtype="float64")
    falls = numbers < numbers.cummax().ffill().shift(fill_value=0)
    if falls.any():
        return int(falls.idxmax())
    return 0 if all(NUMERIC.match(x.strip()) for x in labels) else len(labels)


def parse(raw: bytes, book_id: str) -> dict:
    tags, body = header(decode(raw))
    pages: list[dict] = []
    toc: list[dict] = []

    def open_page(label: str) -> None:
        number = printed(label)
        if not pages or number is None or pages[-1].get("printedPage") != number:
            seq = len(pages) + 1
            pages.append({"id": f"p-{seq:06d}", "sequence": seq, "isBlank": False, "printedPage": number, "sourcePageLabel": label or None, "blocks": []})

    for kind, text in events(body):
        if kind == "page" or not pages:
            open_page(text if kind == "page" else "")
        page = pages[-1]
        if kind == "blank":
            page["isBlank"], page["sourcePageLabel"] = True, page["sourcePageLabel"] or text or None
        elif kind != "page":
            order = len(page["blocks"]) + 1
            block = {"id": f"{page['id']}-b-{order:03d}", "type": kind, "order": order, "text": text}
            if kind == "heading":
                block["tocId"] = f"toc-{len(toc) + 1:05d}"
                toc.append({"id": block["tocId"], "order": len(toc) + 1, "title": text, "pageId": page["id"]})
            page["blocks"].append(block)
    front = front_pages([p["sourcePageLabel"] or "" for p in pages])
    for i, p in enumerate(pages):
        p["pageType"] = "frontMatter" if i < front else "main"
        p["pageNumber"] = f"0.{i + 1}" if i < front else str(p["sequence"] if p["printedPage"] is None else p["printedPage"])
    for entry in toc:
        entry["pageNumber"] = pages[int(entry["pageId"][2:]) - 1]["pageNumber"]
    metadata = {k: tags[t].strip() == TRUE if k in BOOLEANS else tags[t] for t, k in METADATA.items() if tags.get(t)}
    return {"schemaVersion": 2, "bookId": book_id, "title": tags.get(TITLE, ""), "author": tags.get(AUTHOR, ""), "metadata": metadata, "pages": pages, "toc": toc}


def parse_files(files: DataFrame) -> DataFrame:
    """book_id, ok, stage, message, book for files (book_id, content)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for book_id, raw in zip(pdf["book_id"], pdf["content"], strict=True):
                try:
                    rows.append((book_id, True, None, None, json.dumps(parse(raw if raw is not None else b"", book_id), ensure_ascii=False, separators=(",", ":"))))
                except SourceError as e:
                    rows.append((book_id, False, e.stage, str(e), None))
            yield pd.DataFrame(rows, columns=["book_id", "ok", "stage", "message", "json"])

    out = files.select(F.col("book_id").cast("string").alias("book_id"), "content").mapInPandas(run, "book_id string, ok boolean, stage string, message string, json string")
    return out.select("book_id", "ok", "stage", "message", F.from_json("json", BOOK).alias("book"))


def read_marked(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All files of a folder; the id of a book is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return parse_files(files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book_id"), "content"))


STEM = r"([^/]+?)(?:\.[^./]*)?$"


def listing(spark: SparkSession, path: str, glob: str = "*", ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """path, book_id, size of the files of a folder; contents are not read.

    With ids, the files whose stem is one of them, in order of the path; else all in order of the stem as a number, what
    is no number first. A limit keeps the first.
    """
    stem = F.regexp_extract("path", STEM, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", stem.alias("book_id"), F.col("length").alias("size"))
    if ids:
        files = files.filter(F.col("book_id").isin([i.strip() for i in ids])).orderBy("path")
    else:
        files = files.orderBy(F.coalesce(F.when(F.col("book_id").rlike("^[0-9]+$"), F.col("book_id").try_cast("long")), F.lit(0)), "path")
    return files.limit(limit) if limit else files


def headers(files: DataFrame, lines: int = 200, head: int = 1 << 16) -> DataFrame:
    """book_id, tags, error for files (book_id, content): header tags within the first lines, without a look at the body.

    Only the head of a file is sent to Python; a character that it cuts in two is left out.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for book_id, raw, whole in zip(pdf["book_id"], pdf["head"], pdf["whole"], strict=True):
                try:
                    raw = bytes(raw or b"")
                    text = decode(raw if whole else raw[: raw.rfind(b"\n") + 1])
                    tags, _ = header("\n".join(text.split("\n")[:lines]))
                    rows.append((book_id, tags, None))
                except SourceError as e:
                    rows.append((book_id, {}, e.stage))
            yield pd.DataFrame(rows, columns=["book_id", "tags", "error"])

    own = files.select(F.col("book_id").cast("string").alias("book_id"), F.substring("content", 1, head).alias("head"), (F.octet_length("content") <= head).alias("whole"))
    return own.mapInPandas(run, "book_id string, tags map<string,string>, error string")
