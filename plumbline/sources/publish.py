"""What leaves the house: report sources for an external typesetter, and guards over a folder that is to be published."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.files import shipped

# Characters that mean something to the typesetter.
SPECIAL = re.compile(r"([\\#$*_`<>@\[\]~])")
CEILING = 5 << 20
#: Shapes of credentials: private keys, access keys, tokens in a header or an assignment.
SECRETS = {
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "access key": r"\bAKIA[0-9A-Z]{16}\b", "bearer token": r"(?i)bearer\s+[a-z0-9._\-]{20,}",
    "assigned secret": r"(?i)\b(secret|token|password|api_?key)\b\s*[:=]\s*['\"]?[a-z0-9/+_\-]{12,}",
}


def escaped(text: object) -> str:
    return SPECIAL.sub(r"\\\1", "" if text is None else str(text))


def table_source(header: list[str], rows: Iterable[Iterable], right: Iterable[int] = ()) -> list[str]:
    """Lines of a table; the columns in `right` are aligned to the right."""
    sides = ", ".join("right" if i in set(right) else "left" for i in range(len(header)))
    cells = lambda row: "  " + " ".join(f"[{escaped(c)}]," for c in row)
    return ["#table(", f"  columns: {len(header)},", f"  align: ({sides}),", "  table.header(" + ", ".join(f"[*{escaped(c)}*]" for c in header) + "),", *map(cells, rows), ")"]


def report_source(title: str, sections: list[tuple[str, list[str]]]) -> list[str]:
    """Lines of a report: a title, then sections of a heading and their own lines.  Rows in it are of summaries, a few each."""
    lines = [f'#set document(title: "{title}")', f"= {escaped(title)}"]
    for heading, body in sections:
        lines += ["", f"== {escaped(heading)}", *body]
    return lines


def readings(content: bytes) -> Iterator[str]:
    """A file as text; one with zero bytes also as UTF-16, as no pattern matches letters with zeros between them."""
    yield content.decode("utf-8", "ignore")
    if b"\0" in content:
        yield content.decode("utf-16", "ignore")


def findings(spark: SparkSession, folder: str, allowed: list[str], vocabulary: dict[str, str], ceiling: int = CEILING, secrets: dict[str, str] = SECRETS) -> DataFrame:
    """file (below the folder), line (0: the file as a whole), reason: names that no pattern of `allowed` accounts for, files
    over the ceiling (which are not read), and lines with a credential's shape or a word that is not for publication
    (vocabulary: pattern -> reason)."""
    shipped(spark)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().split(":", 1)[-1].lstrip("/")
    patterns = [(p, f"credential: {n}") for n, p in secrets.items()] + list(vocabulary.items())
    schema = "file string, line long, reason string"

    def named(path: str) -> str:
        return path.split(":", 1)[-1].lstrip("/").removeprefix(base).lstrip("/")

    def whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                name = named(path)
                if not any(fnmatch(name, a) for a in allowed):
                    rows.append((name, 0, "not on the list"))
                if length > ceiling:
                    rows.append((name, 0, "over the size ceiling"))
            yield pd.DataFrame(rows, columns=["file", "line", "reason"])

    def lines(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(p), why) for p, why in patterns]
        for pdf in batches:
            rows = set()
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for text in readings(bytes(content)):
                    rows |= {(named(path), i, why) for i, line in enumerate(text.splitlines(), 1) for p, why in compiled if p.search(line)}
            yield pd.DataFrame(sorted(rows), columns=["file", "line", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").mapInPandas(whole, schema).unionByName(files.where(files.length <= ceiling).select("path", "content").mapInPandas(lines, schema))
