"""Files as tables: mail and HTML to text, triplets as CSV. Parsers are those of Python's library, row by row in batches."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLET_COLUMNS = ("source_type", "source_node", "relationship", "destination_type", "destination_node", "description", "keywords")
#: Suffixes of files that are read, and what they are.
KINDS = {"pdf": "pdf", "eml": "email", "msg": "email", "docx": "docx"}


def _text_of(html: str) -> str:
    from html.parser import HTMLParser

    out: list[str] = []

    class Reader(HTMLParser):
        def handle_data(self, data):
            if data.strip():
                out.append(data.strip())

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return "\n".join(out)


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``: the trimmed text nodes of ``column``, one on each line. Null counts as empty."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.fillna("").map(_text_of)

    return pages.withColumn("text", text(column))


def email_pages(files: DataFrame) -> DataFrame:
    """``path, page_number, text, attachments`` of mail files (path, content): headers and the plain parts, else the HTML ones."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy

        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                m = message_from_bytes(bytes(content or b""), policy=policy.default)
                heads = [f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Cc", "Bcc", "Date") if m[h]]
                bodies = {"plain": [], "html": []}
                names = []
                for p in m.walk():
                    if p.is_multipart():
                        continue
                    if p.get_content_disposition() == "attachment":
                        names.append(p.get_filename() or "")
                    elif p.get_content_maintype() == "text" and p.get_content_subtype() in bodies:
                        bodies[p.get_content_subtype()].append(p.get_content().strip())
                body = "\n".join(bodies["plain"]) or "\n".join(map(_text_of, bodies["html"]))
                rows.append((path, 1, "\n".join(heads) + "\n\n" + body, names))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "attachments"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, attachments array<string>")


def classified(files: DataFrame) -> DataFrame:
    """Files (path) with kind by suffix; ``kind`` is null for those that aren't read."""
    suffix = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    return files.withColumn("kind", F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[suffix])


def write_triplets(t: DataFrame, path: str) -> None:
    t.select(*TRIPLET_COLUMNS).write.csv(path, header=True, quote='"', escape='"', mode="errorifexists")


def read_triplets(spark, path: str) -> DataFrame:
    """Triplets of CSV files; empty descriptions and keywords are absent."""
    t = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=", ".join(f"{c} string" for c in TRIPLET_COLUMNS))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.withColumns({"description": blank("description"), "keywords": blank("keywords")})
