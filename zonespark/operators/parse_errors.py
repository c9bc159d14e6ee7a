"""Rows that fail to parse: minimum-cost error parse of delimited records.

A record is fields parted by a delimiter; a field may be enclosed whole in quotes, within which
delimiters, line breaks and doubled quotes are data. A dynamic program over the record finds the
fewest edits, quotes and delimiters inserted or deleted, that bring it into that form with the
right number of fields. Quotes and delimiters are weighed together: two quotes around a stretch can save
many delimiters, one delimiter can give a quote its place.

Records of no cost whose typed fields can be read load as valid. For all others the reason is
stated, in this order: ``quoting`` (as it stands the record has no reading, whatever the number of
fields), ``columns`` (it has one, but needs edits), ``value`` (it needs none, but fields can't be read).

Records without any quote and with the right number of delimiters have no cost, and are split as a
column. The program runs over the others of an Arrow batch at once, one step per run of characters of the
same class; those that need edits are traced back one by one.

Defined cases: one carriage return at the end is ignored; a null record has no field and fails by
``columns``, an empty one has one empty field; repeated lines are parsed each; further columns are
carried along unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States of the record form: at a field's start, in a bare field, inside quotes, after a quote inside quotes.
START, BARE, INSIDE, CLOSED = range(4)
# Classes of characters.
OTHER, QUOTE, DELIM = range(3)
#: NEXT[state][class]: the state after an unedited character, None where the form has no place for it.
NEXT = (
    (BARE, INSIDE, START),
    (BARE, None, START),
    (INSIDE, CLOSED, INSIDE),
    (None, INSIDE, START),
)
#: Insertions before a character in the order in which they can follow each other: (from, to, fields ended, edit).
#: More delimiters at one place are no use: they can as well stand at the end.
INSERT = (
    (INSIDE, CLOSED, 0, "insert quote"),
    *((state, START, 1, "insert delimiter") for state in (BARE, CLOSED, START)),
    (CLOSED, INSIDE, 0, "insert quote"),
    (START, INSIDE, 0, "insert quote"),
)
DELETE = {QUOTE: "delete quote", DELIM: "delete delimiter"}
_BIG = np.int32(1 << 28)


@lru_cache(maxsize=16)
def _runs(quote: str, delimiter: str) -> re.Pattern:
    q, d = re.escape(quote), re.escape(delimiter)
    return re.compile(f"{q}|{d}|[^{q}{d}]+")


def positions(record: str, quote: str, delimiter: str) -> list[int]:
    """Where each quote, delimiter and run of other characters begins, from 1."""
    return [m.start() + 1 for m in _runs(quote, delimiter).finditer(record)]


def _kinds(text: str, table: np.ndarray) -> np.ndarray:
    """The class of each quote, delimiter and run of others; quote and delimiter are ASCII, so bytes will do."""
    kinds = table[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    keep = kinds != OTHER
    keep[1:] |= kinds[:-1] != OTHER
    keep[:1] = True
    return kinds[keep]


def _chunks(lengths: np.ndarray, cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """Records of about equal length together, no chunk above ``cells`` cells when padded (but for one record)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + 4096)
        while end - at > 1 and (end - at) * max(1, lengths[order[end - 1]]) > cells:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


@dataclass(frozen=True)
class Parsed:
    """Of each record: fewest edits; fields as it stands (-1: its quoting has no reading); the edits in words."""

    cost: np.ndarray
    fields: np.ndarray
    edits: list[list[str]]


def _inserted(best: np.ndarray) -> np.ndarray:
    """The costs ``[record, state, fields]`` after insertions before the next character."""
    after = best.copy()
    for was, to, ends, _ in INSERT:
        if ends:
            # from what stood before delimiters, so that one is put in at most
            came = (after if was == CLOSED else best)[:, was, :-1] + 1
            np.minimum(after[:, to, 1:], came, out=after[:, to, 1:])
        else:
            np.minimum(after[:, to], after[:, was] + 1, out=after[:, to])
    return after


def _taken(best: np.ndarray, kind: int) -> np.ndarray:
    """The costs after a character of a class, unedited or deleted."""
    after = np.full_like(best, _BIG)
    for was in range(4):
        to = NEXT[was][kind]
        if to is None:
            continue
        if kind == DELIM and to == START:
            np.minimum(after[:, to, 1:], best[:, was, :-1], out=after[:, to, 1:])
        else:
            np.minimum(after[:, to], best[:, was], out=after[:, to])
    return after if kind == OTHER else np.minimum(after, best + 1)


def error_parse(records: list[str], width: int, quote: str = '"', delimiter: str = ",") -> Parsed:
    """Minimum-cost parse of records into ``width`` fields. A field once ended stays, so that no more than ``width``
    need to be told apart, however many there are."""
    cost, fields = np.zeros(len(records), np.int32), np.ones(len(records), np.int32)
    edits: list[list[str]] = [[] for _ in records]
    table = np.zeros(256, np.int8)
    table[ord(quote)], table[ord(delimiter)] = QUOTE, DELIM
    kinds = [_kinds(r, table) for r in records]
    lengths = np.array([len(k) for k in kinds], np.int64)
    legal = np.array([[-1 if to is None else to for to in row] for row in NEXT] + [[-1] * 3], np.int8)
    for chunk in _chunks(lengths):
        steps = int(lengths[chunk].max())
        grid = np.full((len(chunk), steps), -1, np.int8)
        for row, i in enumerate(chunk):
            grid[row, : len(kinds[i])] = kinds[i]
        # the record as it stands
        state, found = np.full(len(chunk), START, np.int8), np.ones(len(chunk), np.int32)
        for step in range(steps):
            on = grid[:, step] >= 0
            to = legal[state[on], grid[on, step]]
            found[on] += (to == START) & (grid[on, step] == DELIM)
            state[on] = to
        kept = (state >= 0) & (state != INSIDE)
        fields[chunk] = np.where(kept, found, -1)
        open_ = np.flatnonzero(~kept | (found != width))
        if not len(open_):
            continue
        best = np.full((len(open_), 4, width), _BIG, np.int32)
        best[:, START, 0] = 0
        layers = [best]
        for step in range(steps):
            after = best.copy()
            for kind in (OTHER, QUOTE, DELIM):
                rows = np.flatnonzero(grid[open_, step] == kind)
                if len(rows):
                    after[rows] = _taken(_inserted(best[rows]), kind)
            best = after
            layers.append(best)
        for row, i in enumerate(chunk[open_].tolist()):
            cost[i], edits[i] = _trace([layer[row] for layer in layers], kinds[i], positions(records[i], quote, delimiter), len(records[i]) + 1, width)
    return Parsed(cost, fields, edits)


def _trace(layers: list[np.ndarray], kinds: np.ndarray, places: list[int], end: int, width: int) -> tuple[int, list[str]]:
    """The fewest edits of one record and what they are, from the costs before each of its characters."""
    last = layers[len(kinds)].astype(np.int64) + (width - 1 - np.arange(width))
    last[INSIDE] += 1
    # of equal ways the one that leaves most delimiters to the end
    n, state = divmod(int(last.T.argmin()), 4)
    total = int(last[state, n])
    words = [f"insert delimiter x{width - 1 - n}"] if n < width - 1 else []
    if state == INSIDE:
        words.append(f"insert quote at {end}")
    for step in range(len(kinds) - 1, -1, -1):
        kind, before, price = int(kinds[step]), layers[step], int(layers[step + 1][state, n])
        ready = _inserted(before[None])[0]
        came = next(((was, n - ends) for was in range(4) if NEXT[was][kind] == state and (ends := int(kind == DELIM and state == START)) <= n and ready[was, n - ends] == price), None)
        if came is None:
            words.append(f"{DELETE[kind]} at {places[step]}")
            price -= 1
        else:
            state, n = came
        while before[state, n] != price:
            for was, to, ends, edit in reversed(INSERT):
                if to == state and ends <= n and (before if ends and was != CLOSED else ready)[was, n - ends] == price - 1:
                    words.append(f"{edit} at {places[step]}")
                    state, n, price = was, n - ends, price - 1
                    break
    return total, words[::-1]


def repaired(record: str, edits: list[str], quote: str = '"', delimiter: str = ",") -> str:
    """The record with edits made."""
    marks = {"quote": quote, "delimiter": delimiter}
    before: dict[int, str] = {}
    gone, more = set(), ""
    for edit in edits:
        what, mark, *where = edit.split()
        if where[0].startswith("x"):
            more += marks[mark] * int(where[0][1:])
        elif what == "delete":
            gone.add(int(where[1]))
        else:
            before[int(where[1])] = before.get(int(where[1]), "") + marks[mark]
    return "".join(before.get(i, "") + ("" if i in gone else c) for i, c in enumerate(record, 1)) + before.get(len(record) + 1, "") + more


def split(record: str, quote: str = '"', delimiter: str = ",") -> list[str]:
    """The fields of a record that needs no quote edit."""
    if quote not in record:
        return record.split(delimiter)
    out, at, size = [], 0, len(record)
    while True:
        if record[at : at + 1] == quote:
            end = at + 1
            while True:
                end = record.index(quote, end)
                if record[end + 1 : end + 2] != quote:
                    break
                end += 2
            out.append(record[at + 1 : end].replace(quote * 2, quote))
            at = end + 1
        else:
            end = record.find(delimiter, at)
            end = size if end < 0 else end
            out.append(record[at:end])
            at = end
        if at >= size:
            return out
        at += 1


@dataclass(frozen=True)
class Field:
    """A field of the record: its name, and how a typed value is read from its text (null: it can't be).
    A field without ``read`` is kept as text and not judged."""

    name: str
    read: Callable[[Column], Column] | None = None


def _parsed(raw: pa.Array, width: int, quote: str, delimiter: str) -> pa.StructArray:
    """The parse of a batch of records. Records without quotes and with the right number of delimiters are split as a column."""
    line = pc.replace_substring_regex(raw.cast(pa.string()), r"\r\z", "")
    plain = pc.and_(pc.invert(pc.match_substring(line, quote)), pc.equal(pc.count_substring(line, delimiter), width - 1)).fill_null(False)
    rest = pc.and_(pc.invert(plain), line.is_valid())
    plain_at, rest_at, none_at = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, rest, line.is_null()))
    records = line.filter(rest).to_pylist()
    found = error_parse(records, width, quote, delimiter)
    split_text = pc.split_pattern(line.filter(plain), delimiter)
    texts = [None if cost else split(record, quote, delimiter) for record, cost in zip(records, found.cost.tolist(), strict=True)]
    n = len(plain_at), len(none_at)
    cost = np.concatenate([np.zeros(n[0], np.int32), found.cost, np.full(n[1], width - 1, np.int32)])
    count = np.concatenate([np.full(n[0], width, np.int32), found.fields, np.zeros(n[1], np.int32)])
    edits = [*[""] * n[0], *["; ".join(e) for e in found.edits], *[f"insert delimiter x{width - 1}"] * n[1]]
    text = pa.concat_arrays([split_text, pa.array([*texts, *[None] * n[1]], split_text.type)])
    columns = {"cost": pa.array(cost), "fields": pa.array(count, mask=count < 0), "edits": pa.array(edits, pa.string()), "text": text}
    # back into the order of the batch
    order = pa.array(np.argsort(np.concatenate([plain_at, rest_at, none_at]), kind="stable"))
    return pa.StructArray.from_arrays([c.take(order) for c in columns.values()], list(columns))


def parse(lines: DataFrame, raw: str, fields: list[Field], quote: str = '"', delimiter: str = ",") -> DataFrame:
    """``lines`` with the parse of column ``raw`` added as one struct column ``parsed`` (underscores are
    appended while the name is taken):

    ``cost`` (fewest edits), ``fields`` (as the record stands; null where its quoting has no reading), ``edits``
    (text), ``text`` (the texts of the fields, null unless the form is kept), ``value`` (the typed fields) and
    ``reason`` (null: valid). No shuffle: each batch is parsed where it is read.
    """
    width = len(fields)
    name = "parsed"
    while name in lines.columns:
        name += "_"

    schema = T.StructType([*lines.schema.fields, T.StructField(name, T.StructType.fromDDL("cost int, fields int, edits string, text array<string>"))])
    raw_at = lines.columns.index(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = _parsed(batch.column(raw_at), width, quote, delimiter)
            yield pa.RecordBatch.from_arrays([*batch.columns, parsed], [*batch.schema.names, name])

    out = lines.mapInArrow(run, schema)
    at = F.col(name)
    typed = [(f.name, f.read(at["text"][i]) if f.read else at["text"][i]) for i, f in enumerate(fields)]
    value = F.struct(*[v.alias(n) for n, v in typed])
    wrong = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(n)) for (n, v), f in zip(typed, fields, strict=True) if f.read]))
    reason = F.when(at["fields"].isNull(), "quoting").when(at["fields"] != width, "columns").when(F.size(wrong) > 0, "value")
    edits = F.when(reason == "value", F.concat(F.lit("replace "), F.array_join(wrong, ", "))).otherwise(at["edits"])
    return out.withColumn(name, F.struct(at["cost"].alias("cost"), at["fields"].alias("fields"), edits.alias("edits"), at["text"].alias("text"), value.alias("value"), reason.alias("reason")))


# Fixed value: a finite decimal number with optional sign, fraction and exponent.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_decimal(text: Column) -> Column:
    """A finite decimal number as double; spaces and tabs around it are ignored, all else gives null."""
    bare = F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")
    number = F.when(bare.rlike(DECIMAL.replace("$", r"\z")), bare.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)
