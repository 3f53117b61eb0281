"""Fields that hold several values in one string.

The work is done in two passes.  The first one is a plain aggregate over the whole
table: per *source* (by default the wrapper style of the row) each candidate delimiter
gets a score from the consistency of its piece counts and the regularity of its pieces.
The second pass splits every row with the delimiters accepted for its source and
explodes the pieces with their position.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidate delimiters: name -> regular expression.  Some separate values, others stand
#: inside them; which ones do is inferred for each source.
CANDIDATES: dict[str, str] = {
    "comma": r",",
    "semicolon": r";",
    "pipe": r"\|",
    "tab": r"\t",
    "line": r"[\n\r]",
    "bullet": r"[•‣▪●·◦]",
    "slash": r"(?<=\s)/(?=\s)",
    "ampersand": r"(?<=\s)&(?=\s)",
    "plus": r"(?<=\s)\+(?=\s)",
    "colon": r":(?=\s)",
    "dot": r"(?<=[^\s\d])\.(?=\s)",
    "dash": r"(?<=[ \t])[-–—](?=[ \t])",
    "and": r"(?<=\s)(?:and|or)(?=\s)",
    "gap": r"(?<=\S)[ \u00a0]{2,}(?=\S)",
}
#: Candidates whose marks are single characters, wherever they stand.
_PLAIN = {"comma": ",", "semicolon": ";", "pipe": "|", "tab": "\t", "line": "\n\r", "bullet": "•‣▪●·◦"}

STYLES = ("list", "numbered", "bulleted", "plain")
#: Least score of an accepted delimiter.
LEAST_SCORE = 0.4
#: Rows that a candidate's score over all sources counts for in each of them.
_PRIOR = 2.0

_QUOTED = re.compile(r'"(?:[^"\\]|\\[\s\S]|"")*+"|“[^”]*+”')
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What needs more than a split at single characters: quotes, slashes, list marks at the start.
_INTRICATE = rf'["“/]|^[{_SPACES}]*(?:\d{{1,6}}[.)]|[-*–—•][{_SPACES}]|\[)'

_ENUM = re.compile(r"\s*(\d{1,6})([.)])\s+")
_DASH = re.compile(r"\s*[-*–—]\s+")
_UNESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\s\S])")
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

_BLANK = np.zeros(256, bool)
_BLANK[list(b"\0\t\n\x0b\x0c\r ")] = True


def _at(buf: np.ndarray, *chars: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of some characters in a buffer of UTF-8."""
    found = []
    for c in map(str.encode, chars):
        at = np.flatnonzero(buf == c[0])
        for i, byte in enumerate(c[1:], 1):
            at = at[buf[np.minimum(at + i, len(buf) - 1)] == byte]
        found.append((at, at + len(c)))
    return np.concatenate([a for a, _ in found]), np.concatenate([z for _, z in found])


def _marks(buf: np.ndarray, blank: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a candidate's marks in a buffer of texts: what its pattern finds, by bytes."""
    last = len(buf) - 1
    # the end of a text is no white space, yet nothing either
    space = blank & (buf != 0)
    before, after = (lambda a: space[np.maximum(a - 1, 0)] & (a > 0)), (lambda z: space[np.minimum(z, last)])
    if name in _PLAIN:
        return _at(buf, *_PLAIN[name])
    if name == "gap":
        a, z = _at(buf, " ", "\u00a0")
        order = np.argsort(a)
        a, z = a[order], z[order]
        run = np.flatnonzero(np.concatenate([[True], a[1:] != z[:-1]])) if len(a) else np.empty(0, np.int64)
        n, a, z = np.diff(np.append(run, len(a))), a[run], z[np.append(run[1:], len(z)) - 1] if len(a) else z
        keep = (n > 1) & (a > 0) & ~blank[np.maximum(a - 1, 0)] & ~blank[np.minimum(z, last)]
    elif name == "and":
        a = np.flatnonzero(space[:-1]) + 1
        n = np.select([(buf[a] == o) & (buf[np.minimum(a + 1, len(buf) - 1)] == r) & (e == 0 or buf[np.minimum(a + 2, len(buf) - 1)] == e) for o, r, e in (b"or\0", b"and")], [2, 3], 0)
        a, z = a[n > 0], (a + n)[n > 0]
        keep = after(z)
    else:
        a, z = _at(buf, *{"slash": "/", "ampersand": "&", "plus": "+", "colon": ":", "dot": ".", "dash": "-–—"}[name])
        keep = after(z)
        if name == "dot":
            left = buf[np.maximum(a - 1, 0)]
            keep &= (a > 0) & ~blank[np.maximum(a - 1, 0)] & ~((left >= 48) & (left <= 57))
        elif name != "colon":
            keep &= before(a)
    return a[keep], z[keep]


def _piece_counts(texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate, rows, separations, kept pieces, regular pieces) of the rows that hold each candidate.

    Separations are the non-empty pieces less one; a piece is regular if it looks like
    one item: at most sixty bytes in four words.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    raw = b"\0".join(coded) + b"\0"
    buf = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
    blank = _BLANK[buf]
    filled = np.concatenate([[0], np.cumsum(~blank)])
    begins = ~blank
    begins[1:] &= blank[:-1]
    words = np.concatenate([[0], np.cumsum(begins)])
    out = []
    for name in CANDIDATES:
        a, z = _marks(buf, blank, name)
        if not len(a):
            continue
        rows, row = np.unique(np.searchsorted(starts, a, side="right") - 1, return_inverse=True)
        left, right = np.sort(np.concatenate([starts[rows], z])), np.sort(np.concatenate([starts[rows + 1] - 1, a]))
        of = np.searchsorted(starts[rows], left, side="right") - 1
        kept = filled[right] > filled[left]
        regular = kept & (words[right] - words[left] <= 4) & (right - left <= 60)
        n = np.bincount(of[kept], minlength=len(rows))
        if (n > 1).any():
            out.append((name, rows, np.maximum(n - 1, 0), n, np.bincount(of[regular], minlength=len(rows))))
    return out


def delimiter_scores(df: DataFrame, value: str, source: Column | None = None) -> DataFrame:
    """Score of each candidate delimiter per source, over all rows of ``df``.

    Columns ``source, delimiter, rows, consistency, regularity, score``.  Only the text
    outside quotes counts.  *Consistency* says how well a candidate's piece counts agree
    with the rows': the values that it alone separates, as a share of those that the
    row's best candidate separates, on average over the rows that hold it.  A delimiter
    explains most of a row's values; a mark that stands inside values splits off one or
    two.  *Regularity* is the share of its pieces that look like one item.  Both lean
    towards the candidate's figure over all sources where a source has few rows.
    Null values are ignored; an empty table gives no rows.  Each batch is reduced to its
    sums before anything is shuffled.
    """
    v = F.col(value)
    given = F.coalesce(source.cast("string"), F.lit("")) if source is not None else F.lit("")
    base = df.where(v.isNotNull() & (v != "")).select(given.alias("source"), v.alias("v"))
    by_style = source is None
    names = ["rows", "agreeing", "pieces", "regular"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            sources = (pa.array([_style(t) for t in texts], pa.string()) if by_style else batch.column(0)).dictionary_encode()
            code, k = np.asarray(sources.indices), len(sources.dictionary)
            texts = [_QUOTED.sub("Q", t) if '"' in t or "“" in t else t for t in texts]
            counted = _piece_counts(texts)
            most = np.ones(len(texts))
            for _, rows, n, _, _ in counted:
                most[rows] = np.maximum(most[rows], n)
            for name, rows, n, pieces, regular in counted:
                held = n > 0
                sums = [np.bincount(code[rows][held], w[held], k) for w in (np.ones(len(rows)), n / most[rows], pieces, regular)]
                at = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([sources.dictionary.take(pa.array(at)), pa.array([name] * len(at), pa.string()), *[pa.array(s[at]) for s in sums]], ["source", "delimiter", *names])

    sums = base.mapInArrow(partial, "source string, delimiter string, " + ", ".join(f"{n} double" for n in names)).groupBy("source", "delimiter").agg(*[F.sum(n).alias(n) for n in names])
    over_all = sums.groupBy("delimiter").agg((F.sum("agreeing") / F.sum("rows")).alias("c"), F.try_divide(F.sum("regular"), F.sum("pieces")).alias("r"), (F.sum("pieces") / F.sum("rows")).alias("p"))
    n, p = F.col("rows"), F.col("p")
    return sums.join(over_all, "delimiter").select(
        "source", "delimiter", n.cast("long").alias("rows"),
        ((F.col("agreeing") + _PRIOR * F.col("c")) / (n + _PRIOR)).alias("consistency"),
        ((F.col("regular") + _PRIOR * p * F.col("r")) / (F.col("pieces") + _PRIOR * p)).alias("regularity"),
    ).withColumn("score", F.col("consistency") * F.col("regularity"))


def accepted_delimiters(df: DataFrame, value: str, least: float = LEAST_SCORE, source: Column | None = None) -> DataFrame:
    """``source, delimiters``: the accepted delimiters of each source, in the order of the candidates."""
    order = F.array(*map(F.lit, CANDIDATES))
    got = delimiter_scores(df, value, source).where(F.col("score") >= least).groupBy("source").agg(F.collect_set("delimiter").alias("d"))
    return got.select("source", F.filter(order, lambda x: F.array_contains("d", x)).alias("delimiters"))


def infer_delimiters(df: DataFrame, value: str, least: float = LEAST_SCORE) -> dict[str, list[str]]:
    """Accepted delimiters of each wrapper style: four rows at most are fetched."""
    return {s: list(d) for s, d in accepted_delimiters(df, value, least).collect()}


def _unescape(m: re.Match) -> str:
    x = m.group(1)
    if len(x) > 1:
        return chr(int(x[1:], 16))
    return _CONTROL.get(x, x)


class Splitter:
    """Splits one packed string; made once per batch of rows."""

    def __init__(self, delimiters: list[str]):
        self.sep = "|".join(CANDIDATES[d] for d in delimiters) or r"(?!)"
        self.split = re.compile(self.sep).split
        # a quote opens only at the start of a piece and closes only at its end
        end = rf"(?=\s*(?:{self.sep}|$))"
        self.piece = re.compile(
            rf"\s*(?:(?:\d{{1,6}}[.)]|[-*–—])\s+)?(?:\"(?P<d>(?:[^\"\\]|\\[\s\S]|\"\")*)\"|“(?P<c>[^”]*)”){end}"
        )
        self.next = re.compile(self.sep).search

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """(kind, body) of each piece: kind is '' for bare, 'q' for quoted pieces."""
        out, at = [], 0
        while at <= len(text):
            m = self.piece.match(text, at)
            if m:
                head = text[at : m.start("d") if m.group("d") is not None else m.start("c")].rstrip('"“ \t\n\r\xa0').strip()
                body = m.group("d")
                if body is not None:
                    body = body.replace('""', '"')
                    if "\\" in body:
                        body = _UNESCAPE.sub(_unescape, body)
                else:
                    body = m.group("c")
                out.append((f"q{head}", body))
                stop = self.next(text, m.end())
            else:
                stop = self.next(text, at)
                out.append(("", text[at : stop.start() if stop else len(text)]))
            if not stop:
                break
            at = stop.end()
        return out

    def __call__(self, text: str) -> list[str]:
        if '"' not in text and "“" not in text:
            bare = [x for x in map(str.strip, self.split(text)) if x]
            if bare and _ENUM.match(text):
                if self._numbered([("", x) for x in bare]):
                    bare = [x for x in (_ENUM.sub("", b + " ", count=1).strip() for b in bare) if x]
            elif bare and _DASH.match(text):
                bare = [x for x in (_DASH.sub("", b, count=1) for b in bare) if x]
            return bare
        bare = [x for x in map(str.strip, self.split(text)) if x]
        if not _ENUM.match(text) and not _DASH.match(text) and "\\" not in text:
            # no quoted value holds a delimiter: every quote ends in its own piece
            out = []
            for x in bare:
                if '"' in x or "“" in x or "”" in x:
                    pair = x[0] + x[-1]
                    if len(x) < 2 or not (pair == '""' and x.count('"') == 2 and "“" not in x or pair == "“”" and x.count("“") == x.count("”") == 1 and '"' not in x):
                        break
                    x = x[1:-1].strip()
                if x:
                    out.append(x)
            else:
                return out
        parts = self.pieces(text)
        if _ENUM.match(text) and self._numbered(parts):
            parts = [(k, b if k else _ENUM.sub("", b, count=1)) for k, b in parts]
        elif _DASH.match(text):
            parts = [(k, b if k else _DASH.sub("", b, count=1)) for k, b in parts]
        return [b for b in (body.strip() for _, body in parts) if b]

    @staticmethod
    def _numbered(parts: list[tuple[str, str]]) -> bool:
        """Every piece with content carries the next number, from 1."""
        n = 0
        for kind, body in parts:
            if not kind and not body.strip():
                continue
            m = _ENUM.match(kind[1:] + " ") if kind else _ENUM.match(body + " ")
            n += 1
            if not m or int(m.group(1)) != n:
                return False
        return True


_ITEM = re.compile(
    r"\s*(?:\"(?P<d>(?:[^\"\\]|\\[\s\S]|\"\")*)\"|'(?P<s>(?:[^'\\]|\\[\s\S])*)'|“(?P<c>[^”]*)”)\s*(?=[,;|]|$)"
)


def split_list(text: str, plain: Splitter) -> list[str]:
    """Elements of a bracketed list in JSON or in the notation of Python."""
    body = text.strip()
    if body[1:2] == "'" and '"' not in body and "\\" not in body:  # the plain notation of Python
        items = body[2:-2].split("', '")
        if body[-2:-1] == "'" and body.count("'") == 2 * len(items):
            return [e for e in map(str.strip, items) if e]
    try:
        x = json.loads(body)
        if all(isinstance(e, str) for e in x):
            return [e for e in (e.strip() for e in x) if e]
    except ValueError:
        pass
    body, out, at = body[1:-1], [], 0
    while at < len(body):
        m = _ITEM.match(body, at)
        if m:
            e = m.group("d")
            if e is None:
                e = m.group("s") if m.group("s") is not None else m.group("c")
            out.append(_UNESCAPE.sub(_unescape, e) if "\\" in e else e)
            stop = plain.next(body, m.end())
        else:
            stop = plain.next(body, at)
            out.append(body[at : stop.start() if stop else len(body)])
        if not stop:
            break
        at = stop.end()
    return [e for e in (e.strip() for e in out) if e]


_BULLETED = re.compile(r"[-*–—•]\s[^\n•]*(?:\n\s*(?:[-*–—•]\s[^\n•]*)?)*")


def _style(text: str) -> str:
    """Wrapper style: list, numbered, bulleted (each line begins with a mark and holds no second one) or plain."""
    t = text.strip()
    if t[:1] == "[" and t[-1:] == "]":
        return "list"
    if t[:1] == "1" and re.match(r"1[.)]\s", t):
        return "numbered"
    return "bulleted" if t[:1] in "-*–—•" and _BULLETED.fullmatch(t) else "plain"


def _split_plain(texts: pa.Array, marks: str) -> pa.ListArray:
    """Pieces between single characters, trimmed, the empty ones dropped."""
    parts = pc.split_pattern_regex(texts, f"[{re.escape(marks)}]")
    flat = pc.utf8_trim(parts.flatten(), _SPACES)
    kept = np.asarray(pc.not_equal(flat, "")).astype(bool)
    off = np.concatenate([[0], np.cumsum(kept)])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), flat.filter(pa.array(kept)))


class _Rows:
    """Splits rows of text; the delimiters of a row are those of its style, or given with it."""

    def __init__(self, accepted: dict[str, list[str]] | None):
        self.accepted = accepted
        self.made: dict[tuple[str, ...], Splitter] = {}

    def splitter(self, delimiters) -> Splitter:
        key = tuple(delimiters or ())
        if key not in self.made:
            if len(self.made) >= 1000:  # many sources: those made first are made again when needed
                self.made.clear()
            self.made[key] = Splitter(list(key))
        return self.made[key]

    def one(self, text: str, delimiters=None) -> list[str]:
        style = _style(text)
        s = self.splitter(self.accepted.get(style) if self.accepted is not None else delimiters)
        return split_list(text, s) if style == "list" else s(text)

    def by_style(self, texts: pa.Array) -> pa.ListArray:
        """Rows of the plain style without quotes are split together, the others one by one."""
        texts = pc.fill_null(texts, "")
        plain = self.accepted.get("plain", [])
        if not all(d in _PLAIN or d == "slash" for d in plain) or not plain:
            return pa.array([self.one(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        hard = np.asarray(pc.match_substring_regex(texts, _INTRICATE)).astype(bool)
        easy = _split_plain(texts.filter(pa.array(~hard)), "".join(_PLAIN[d] for d in plain if d in _PLAIN))
        rest = pa.array([self.one(t) for t in texts.filter(pa.array(hard)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(texts), np.int64)
        place[~hard], place[hard] = np.arange(len(easy)), len(easy) + np.arange(len(rest))
        return pa.concat_arrays([easy, rest]).take(pa.array(place))


def split_udf(accepted: dict[str, list[str]]):
    """Arrow function string -> array<string> for the delimiters accepted for each wrapper style."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = _Rows(accepted)
        for texts in batches:
            yield rows.by_style(texts)

    return split


def split_with_udf():
    """Arrow function (string, delimiters) -> array<string>, for rows that bring their delimiters."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rows = _Rows(None)
        for texts, delimiters in batches:
            yield pa.array([rows.one(t, d) if t else [] for t, d in zip(texts.to_pylist(), delimiters.to_pylist())], pa.list_(pa.string()))

    return split


def split_arrays(df: DataFrame, keys: list[str], value: str, out: str = "values", accepted: dict[str, list[str]] | None = None, source: Column | None = None) -> DataFrame:
    """The ``keys`` and the packed values of each row as one array, in order; null fields give an empty array.

    Delimiters are inferred per wrapper style, or per ``source`` where that is given: the
    accepted ones are then joined to the rows, so any number of sources will do.
    """
    slim = df.select(*keys, F.col(value).alias("__packed"), *([F.coalesce(source.cast("string"), F.lit("")).alias("__source")] if source is not None else []))
    if source is not None:
        found = accepted_delimiters(slim, "__packed", source=F.col("__source")).withColumnRenamed("source", "__source")
        return slim.join(found, "__source", "left").select(*keys, split_with_udf()("__packed", "delimiters").alias(out))
    if accepted is None:
        accepted = infer_delimiters(slim, "__packed")
    return slim.select(*keys, split_udf(accepted)("__packed").alias(out))


def unpacked(df: DataFrame, value: str, accepted: dict[str, list[str]] | None = None) -> tuple[DataFrame, Callable[[], Callable[[pa.Array], pa.ListArray]]]:
    """The packed column alone, and a maker of the function that splits its Arrow arrays.

    For operators whose own Arrow function reads the values: they are split where they
    are used and don't travel once more.
    """
    slim = df.select(F.col(value).alias("packed"))
    known = infer_delimiters(slim, "packed") if accepted is None else accepted
    return slim, lambda: _Rows(known).by_style


def split_packed(df: DataFrame, keys: list[str], value: str, out: str = "value", accepted: dict[str, list[str]] | None = None, source: Column | None = None) -> DataFrame:
    """One row per packed value: the ``keys``, ``pos`` (from 1, kept values) and ``out``.

    Quotes, escapes, brackets, bullets and list numbers that belong to the packing are
    removed, white space of any kind is trimmed at both ends and empty values are
    dropped.  Nothing separates inside quotes.  Null, blank and empty fields give no
    row; repeated values are all kept; very long fields are split in linear time.  Other
    columns of ``df`` are ignored, so clashing names don't matter.  ``source`` says where
    a row comes from; a null source is one of its own.
    """
    filled = df.where(F.col(value).isNotNull())
    arrays = split_arrays(filled, keys, value, "__values", accepted, source)
    return arrays.select(*keys, F.posexplode("__values").alias("__pos", out)).select(*keys, (F.col("__pos") + 1).cast("int").alias("pos"), out)
