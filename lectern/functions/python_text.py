"""Text functions that need sequential logic or Unicode tables: plain functions of one value, and
`column` to apply one to a column in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.sentences import scan_sentences
from lectern.functions.text import MOJIBAKE

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S)
_END = re.compile(r"[.!?][\"')\]]*(?=\s|$)")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def column(f: Callable[[Any], Any], kind: T.DataType = T.StringType()) -> Callable[[Column], Column]:
    """f over a column; null in gives null out."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], arrow)

    return run


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def repair_mojibake(text: str) -> str:
    """The text, or what its bytes in Latin-1 or cp1252 say in UTF-8 if that holds fewer damaged sequences."""
    def damage(t: str) -> int:
        return sum(t.count(m) for m in MOJIBAKE)

    best = text
    for codec in ("latin-1", "cp1252"):
        try:
            other = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if damage(other) < damage(best):
            best = other
    return best


def first_json_object(text: str) -> str | None:
    """The first run from { to the } that closes it, braces in strings apart; null if none closes."""
    start, depth = -1, 0
    for m in _TOKEN.finditer(text, max(0, text.find("{"))):
        if m[0] == "{":
            start = m.start() if not depth else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def parse_prefix(text: str) -> dict:
    """status (exact, prefix, none), json and the text outside it."""
    flat = text.strip()
    try:
        value, end = json.JSONDecoder().raw_decode(flat)
    except ValueError:
        return {"status": "none", "json": None, "outside": flat}
    outside = flat[end:].strip()
    return {"status": "prefix" if outside else "exact", "json": json.dumps(value, ensure_ascii=False), "outside": outside}


def stable_hash(record: str) -> str | None:
    """SHA-256 of a JSON record with sorted keys; null if it isn't JSON."""
    try:
        return hashlib.sha256(json.dumps(json.loads(record), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    except ValueError:
        return None


def schema_issues(value: Any, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema of $ref, const, enum, type, required, properties,
    additionalProperties, items, minItems, maxItems, minLength, maxLength."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return schema_issues(value, target, root, path)
    out = []
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: const")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: enum")
    kind = schema.get("type")
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = kind is None or (numeric and (kind == "number" or kind == "integer" and value == int(value)) if kind in ("number", "integer") else isinstance(value, _TYPES[kind]))
    if not fits:
        return [*out, f"{path}: type"]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: additional" for k in value if k not in known]
        for k, v in value.items():
            if k in known:
                out += schema_issues(v, known[k], root, f"{path}.{k}")
    if isinstance(value, (list, str)):
        least, most = ("minItems", "maxItems") if isinstance(value, list) else ("minLength", "maxLength")
        out += [f"{path}: {least}"] * (len(value) < schema.get(least, 0)) + [f"{path}: {most}"] * (len(value) > schema.get(most, len(value)))
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_issues(v, schema["items"], root, f"{path}[{i}]")
    return out


def join_broken_lines(text: str) -> str:
    """Lines that a page break cut: hyphenated words, and lines that go on in lower case or with a bracket."""
    text = re.sub(r"(?<=[A-Za-z])-\n(?=[a-z])", "", text)
    return re.sub(r"(?<=[^\n.!?:])\n(?=[a-z(\[0-9])", " ", text)


def trim_to_sentence(text: str, least: int = 0) -> str:
    """The longest beginning that ends with a sentence and has `least` words; the text if there is none."""
    ends = [m.end() for m in _END.finditer(text)]
    fits = [e for e in ends if len(text[:e].split()) >= least]
    return text[: fits[-1]] if fits else text


def paragraphs(text: str, words: int = 90) -> list[str]:
    """Parts between blank lines; a text without any goes in parts of whole sentences of about `words`."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(parts) > 1:
        return parts
    out: list[str] = []
    n = words
    for s in scan_sentences(text):
        if n >= words:
            out.append(s)
            n = 0
        else:
            out[-1] += " " + s
        n += len(s.split())
    return out


def simplify(text: str, most: int = 22) -> str:
    """Sentences longer than `most` words cut at semicolons, or at commas before a joining word, two to a paragraph."""
    short = []
    for s in scan_sentences(text):
        parts = re.split(r";\s+|,\s+(?=(?:and|but|so|because|which|while|although)\b)", s) if len(s.split()) > most else [s]
        short += [p[:1].upper() + p[1:].rstrip(" ,;") + ("" if p.rstrip()[-1:] in ".!?" else ".") for p in parts if p.strip()]
    return "\n\n".join(" ".join(short[i : i + 2]) for i in range(0, len(short), 2))


def nested_text(value: Any) -> str:
    """Strings of a nested value in order, one to a line."""
    if isinstance(value, str):
        return value.strip()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return "\n".join(t for t in map(nested_text, inner) if t)
