"""Records of a feature-info answer: nested lists and mappings told by indentation, read in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which a survey answers, and those of the columns here.
FIELDS = {
    "product_id": "product_id", "resolution": "resolution_mpp", "center_longitude": "center_lon", "center_latitude": "center_lat",
    "incidence_angle": "incidence_angle_deg", "emission_angle": "emission_angle_deg", "phase_angle": "phase_angle_deg",
}
#: A key with a colon after it; a key in quotes may hold colons. What follows a blank and # is a remark.
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\[\]{}&*!|>%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)\s*""")
QUOTED = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", '"': '"', "/": "/", "\\": "\\", " ": " "}
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", re.S)
NOTHING = ("", "~", "null", "Null", "NULL")


def unescaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if not code and m[4] not in ESCAPES:
        raise ValueError(f"no escape: {m[0]}")
    return chr(int(code, 16)) if code else ESCAPES[m[4]]


def scalar(text: str) -> str | list | dict | None:
    """A value on one line: its text, None where it says nothing, or an empty list or mapping."""
    if text[:1] in ("'", '"'):
        m = QUOTED.fullmatch(text)
        if not m:
            raise ValueError(f"quotes that do not end: {text}")
        return m[1][1:-1].replace("''", "'") if text[0] == "'" else ESCAPE.sub(unescaped, m[1][1:-1])
    text = re.split(r"(?:^|\s)#", text, maxsplit=1)[0].rstrip()
    if text in ("[]", "{}"):
        return [] if text == "[]" else {}
    if text[:1] in tuple("[]{}&*!|>%@`,") or re.search(r":(\s|$)", text):
        raise ValueError(f"no value of one line: {text}")
    return None if text in NOTHING else text


class Frame:
    """A list or mapping that is open, the column where its entries begin, and its entry whose value may still follow below."""

    def __init__(self, column: int, node: list | dict):
        self.column, self.node, self.waits = column, node, None

    def put(self, value) -> None:
        if isinstance(self.node, list):
            self.node[-1] = value
        else:
            self.node[self.waits] = value
        self.waits = None


def parsed(text: str) -> dict | list | str | None:
    """The document in ``text``: mappings, lists and one-line values (as text), by indentation.

    A stack holds what is open; a line closes what begins right of it and goes on with what begins there, or opens a
    list or mapping as the value that the entry above waits for. ValueError for anything else: columns that nothing
    begins at, tabs before an entry, list entries among keys, quotes without end, anchors, tags, several documents.
    """
    top = Frame(-1, {})
    top.waits = "document"
    stack, plain = [top], None
    for line in text.replace("\r\n", "\n").split("\n"):
        rest = line.lstrip(" ")
        if not rest.strip() or rest.lstrip().startswith("#") or line.rstrip() in ("---", "..."):
            if line.rstrip() == "---" and (len(stack) > 1 or plain is not None):
                raise ValueError("several documents")
            continue
        column = len(line) - len(rest)
        while True:
            dash = rest == "-" or rest.startswith("- ")
            key = None if dash else KEY.match(rest)
            if not dash and not key:
                frame = stack[-1]
                if frame.waits is None or column <= frame.column or plain is not None:
                    raise ValueError(f"neither a key nor an entry: {line}")
                if frame is top:
                    plain = rest
                frame.put(scalar(rest))
                break
            while stack[-1].column > column or (stack[-1].column == column and isinstance(stack[-1].node, list) and not dash):
                stack.pop()
            frame = stack[-1]
            # a list may begin in the column of the key that it belongs to
            if frame.column < column or (frame.column == column and dash and isinstance(frame.node, dict)):
                if frame.waits is None:
                    raise ValueError(f"nothing begins here: {line}")
                node = [] if dash else {}
                frame.put(node)
                stack.append(frame := Frame(column, node))
            if isinstance(frame.node, list) != dash:
                raise ValueError(f"a list and keys mixed: {line}")
            if dash:
                frame.node.append(None)
                frame.waits, value = "last", rest[1:].lstrip(" ")
                column += len(rest) - len(value)
                if not value or value.startswith("#"):
                    break
                rest = value
                if not (rest == "-" or rest.startswith("- ") or KEY.match(rest)):
                    frame.put(scalar(rest))
                    break
                continue
            name = scalar(key[1])
            value = rest[key.end() :]
            frame.node[name] = None
            frame.waits = name
            if value and not value.startswith("#"):
                frame.put(scalar(value))
            break
    return top.node.get("document")


def of_layer(body: bytes, layer: str) -> list[dict]:
    """The records that an answer lists under ``layer``; none where it is malformed or says something else."""
    try:
        found = parsed(body.decode("utf-8", "ignore"))
    except (ValueError, OverflowError):
        return []
    found = found.get(layer) if isinstance(found, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def records(answers: DataFrame, layer: str, body: str = "body") -> DataFrame:
    """A row for each record of the answers' ``layer``: the answer's other columns and FIELDS as text, null where they lack.

    Null bodies, malformed ones and those without the layer give no row; lists and mappings as values are null.
    ``catalog.clean_products`` makes numbers of them.
    """
    names = list(FIELDS.values())
    keep = [c for c in answers.columns if c != body and c not in names]
    src = answers.where(F.col(f"`{body}`").isNotNull()).select(*[f"`{c}`" for c in keep], F.col(f"`{body}`").cast("binary").alias(body))
    kind = src.select(*[f"`{c}`" for c in keep], *[F.lit(None).cast("string").alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of_layer(x, layer) for x in b.column(len(keep)).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            value = lambda x: x if isinstance(x, str) else None
            columns = [pa.array([value(r.get(f)) for rows in found for r in rows], pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), *columns], names=[*keep, *names])

    return src.mapInArrow(run, kind)


def record_text(fields: dict[str, Column]) -> Column:
    """One record as the service writes it: a list entry of keys and values, without those that are null."""
    lines = [F.concat(F.lit(f"{name}: "), x.cast("string")) for name, x in fields.items()]
    return F.concat(F.lit("  - "), F.concat_ws("\n    ", *lines), F.lit("\n"))
