"""Times in many notations and zones, normalised to one unambiguous form.

Each value gives the array of all its valid interpretations (notation, instant, normal form, prior cost). Over the records of
one source, in their order of arrival, a Viterbi pass chooses one interpretation per value: it adds to the prior costs a
penalty for each change of notation and one for each jump back in time. What the source declares enters as prior costs: the other
order of day and month than the declared one, the second of two equal local times, and, where every interpretation contradicts
what is declared, that the value states no valid time. A declaration costs more than the penalties around one value can, so it
holds; where a source declares nothing the sequence decides.

The records are range-partitioned by (sequence, arrival, key), so one source of a third of all rows is spread over many
tasks, and the pass doesn't depend on the borders: each partition first sums up its first and last sequence as a min-plus matrix from the
interpretations of its first value to those of its last, the matrices (two a partition) are composed along the chains, and each
partition then decides with the exact costs that stand before and behind it. Costs are integers, so sums agree in any order. Only
the values on which the cheapest paths still differ are held.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampora.session import cut_lineage

# A candidate's place costs one, so that ties go to the earlier one.
SWITCH_COST, BACK_COST, BACK_SPAN_US = 1_000_000, 1_000_000, 30 * 86_400_000_000
# At most two changes and two jumps stand around a value, so both outweigh them.
INVALID_COST, ORDER_COST = 8_000_000, 10_000_000
FOLD_COST = 10**12
NO_TIME = ("", None, None, INVALID_COST)

# Names of the months, January first, in the languages that occur.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "short": "jan feb mar apr may jun jul aug sep oct nov dec",
}
MONTHS = {name: i for names in MONTH_NAMES.values() for i, name in enumerate(names.split(), 1)} | {"sept": 9, "setiembre": 9}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "一": 1, "二": 2, "三": 3, "四": 4, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4}
# Hours ahead of UTC of zone abbreviations; one that the source's own zone uses is read in that zone.
ZONE_HOURS = {"utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "eat": 3, "cat": 2, "gst": 4, "ist": 5.5, "ict": 7, "wib": 7, "hkt": 8, "sgt": 8, "jst": 9, "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13, "brt": -3, "art": -3, "clt": -4, "cot": -5, "pet": -5, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
NAMED_ZONES = {"北京时间": "Asia/Shanghai", "beijing time": "Asia/Shanghai"}

_CLOCK = r"(?:(?P<half>上午|下午|凌晨|晚上|中午)\s*)?(?P<h>\d{1,2})(?:[:.h点时])(?P<mi>\d{2})(?:(?:[:分])(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*[分秒]?(?:\s*(?P<ap>am|pm|a\.m\.|p\.m\.))?(?:\s*uhr)?"
_ZONE = r"\s*\(?(?P<zone>z|[+-]\d{2}:?\d{2}|(?:utc|gmt)\s*[+-]\s*\d{1,2}(?::?\d{2})?|[a-z]{3,4}|北京时间|beijing time)?\)?"
_WORD = r"[^\W\d_]+"
_DAY = {
    "iso": r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})",
    "han": r"(?P<y>\d{4})\s*年\s*(?P<mo>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*[日号]",
    "num": r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})",
    "dmy": rf"(?:{_WORD},?\s+)?(?P<d>\d{{1,2}})\.?(?:\s+de)?[\s-]+(?P<name>{_WORD})\.?(?:\s+de)?[\s,-]+(?P<y>\d{{4}}|\d{{2}})",
    "mdy": rf"(?P<name>{_WORD})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})",
}
_TIMES = [(k, re.compile(rf"{p}(?:(?:\s*t\s*|\s*,?\s*(?:à|at|um|a las|às)?\s*){_CLOCK}{_ZONE})?")) for k, p in _DAY.items()]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?P<zone>z|[+-]\d{2}:?\d{2})?")
_MONTH = [
    re.compile(r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})"),
    re.compile(r"(?P<mo>\d{1,2})[-/.](?P<y>\d{4})"),
    re.compile(r"(?P<y>\d{4})\s*年\s*(?P<mo>\d{1,2})\s*月份?"),
    re.compile(rf"(?P<name>{_WORD})\.?(?:\s+de|\s+of)?[\s,-]+(?P<y>\d{{4}}|\d{{2}})"),
]
_QUARTER = [
    re.compile(r"[qt](?P<q>[1-4])[\s/-]*(?P<y>\d{4})"),
    re.compile(r"(?P<y>\d{4})[\s/-]*[qt](?P<q>[1-4])"),
    re.compile(r"(?P<q>[1-4])\.\s*quartal\s+(?P<y>\d{4})"),
    re.compile(r"(?P<o>first|second|third|fourth|[1-4](?:st|nd|rd|th))\s+quarter(?:\s+of)?\s+(?P<y>\d{4})"),
    re.compile(r"(?P<y>\d{4})\s*年\s*第?(?P<o>[一二三四1-4])\s*季度"),
    re.compile(r"(?P<q>[1-4])\.?(?:er|e|º|°)?\s*(?:trimestre)(?:\s+de)?\s+(?P<y>\d{4})"),
]
_YEAR = re.compile(r"(?:fy|in|en|em|im jahr|ano|año|year)?\s*(?P<y>(?:19|20)\d{2})\s*年?(?:底|内)?")


@lru_cache(256)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def _offset(text: str, source_zone: ZoneInfo | None, local: datetime):
    """The zone that ``text`` states, None where it's not known."""
    t = text.strip()
    if t in NAMED_ZONES:
        return _zone(NAMED_ZONES[t])
    if m := re.fullmatch(r"(?:utc|gmt)?\s*([+-])\s*(\d{1,2}):?(\d{2})?", t):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60:
            return None
        return timezone(timedelta(minutes=minutes if m[1] == "+" else -minutes))
    if source_zone is not None and t not in ("utc", "gmt", "z"):
        for fold in (0, 1):
            at = local.replace(tzinfo=source_zone, fold=fold)
            if (at.tzname() or "").casefold() == t:
                return timezone(at.utcoffset())
        for at in (local.replace(month=1, day=15, tzinfo=source_zone), local.replace(month=7, day=15, tzinfo=source_zone)):
            if (at.tzname() or "").casefold() == t:
                return timezone(at.utcoffset())
    return timezone(timedelta(hours=ZONE_HOURS[t])) if t in ZONE_HOURS else None


def _year(text: str) -> int:
    return int(text) if len(text) == 4 else 2000 + int(text)


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_MICRO = timedelta(microseconds=1)


def _instants(fmt: str, local: datetime, stated, zone: ZoneInfo | None) -> list[tuple]:
    if stated is not None:
        tz, folds = stated, (0,)
    else:
        tz, folds = zone or UTC, (0, 1)
    out = []
    for fold in folds:
        at = local.replace(tzinfo=tz, fold=fold).astimezone(UTC)
        us = (at - _EPOCH) // _MICRO
        if not out or out[0][1] != us:
            out.append((fmt, us, f"{at.year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond:06d}Z", FOLD_COST * fold))
    # A local time that a change of clocks leaves out gives two instants as well; it is read with the offset before.
    return out


def interpretations(value: str | None, time_zone: str | None, date_order: str | None) -> list[tuple[str, int | None, str | None, int]]:
    """All valid interpretations of ``value`` as ``(notation, microseconds since 1970, normal form, prior cost)``.

    Where all of them contradict what the source declares, ``NO_TIME`` is one more.
    """
    if not value:
        return []
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).casefold()).strip()
    if not t or not any(c.isdigit() for c in t):
        return []
    try:
        found = _interpretations(t, _zone(time_zone), date_order)
    except (ValueError, OverflowError):
        return []
    if found and all(c[3] >= ORDER_COST and c[3] < FOLD_COST for c in found):
        found.append(NO_TIME)
    return [(*c[:3], c[3] + i) for i, c in enumerate(found)]


def _orders(declared: str | None) -> tuple[str, str]:
    """Both orders of day and month, the declared one first."""
    return ("mdy", "dmy") if declared == "mdy" else ("dmy", "mdy")


def _against(order: str, declared: str | None) -> int:
    """What reading day and month in ``order`` costs where the source declares another."""
    return ORDER_COST if order and declared in ("dmy", "mdy") and order != declared else 0


def _day(fmt: str, y: int, mo: int, d: int) -> tuple:
    day = date(y, mo, d)
    return fmt, (day.toordinal() - 719_163) * 86_400_000_000, day.isoformat(), 0


def _span(fmt: str, y: int, mo: int, text: str) -> tuple:
    return fmt, (date(y, mo, 1).toordinal() - 719_163) * 86_400_000_000, text, 0


def _interpretations(t: str, zone: ZoneInfo | None, order: str | None) -> list[tuple]:
    if t.isdecimal():
        n = len(t)
        if n in (10, 13, 16) or n == 11 and t[0] == "1":
            scale = {10: 1_000_000, 13: 1000, 16: 1}.get(n)
            if scale is None:
                return []
            us = int(t) * scale
            at = _EPOCH + timedelta(microseconds=us)
            return [(f"epoch{n}", us, f"{at.year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond:06d}Z", 0)]
        if n == 8:
            out = []
            if t[:2] in ("19", "20"):
                return [_day("ymd8", int(t[:4]), int(t[4:6]), int(t[6:]))]
            for o in _orders(order):
                a, b, y = int(t[:2]), int(t[2:4]), int(t[4:])
                try:
                    out.append((*_day(f"{o}8", y, *((b, a) if o == "dmy" else (a, b)))[:3], _against(o, order)))
                except ValueError:
                    pass
            return out
        if n == 4:
            return [_span("year", int(t), 1, t)] if t[:2] in ("19", "20") else []
        if n == 6 and t[:2] in ("19", "20"):
            return [_span("ym6", int(t[:4]), int(t[4:]), f"{t[:4]}-{t[4:]}")]
        if n not in (12, 14):
            return []
    if m := _COMPACT.fullmatch(t):
        local = datetime(int(m["y"]), int(m["mo"]), int(m["d"]), int(m["h"]), int(m["mi"]), int(m["s"] or 0))
        stated = _offset(m["zone"], zone, local) if m["zone"] else None
        return _instants("compact", local, stated, zone)
    for kind, pattern in _TIMES:
        if not (m := pattern.fullmatch(t)):
            continue
        g = m.groupdict()
        orders = ("",)
        if kind == "num":
            orders = _orders(order)
        elif "name" in g and g["name"] not in MONTHS:
            continue
        out = []
        for o in orders:
            try:
                y = _year(g["y"])
                if kind == "num":
                    mo, d = (int(g["b"]), int(g["a"])) if o == "dmy" else (int(g["a"]), int(g["b"]))
                else:
                    mo, d = MONTHS[g["name"]] if "name" in g else int(g["mo"]), int(g["d"])
                fmt = f"{kind}{o}{g.get('sep') or ''}"
                if g["h"] is None:
                    out.append((*_day(fmt, y, mo, d)[:3], _against(o, order)))
                    continue
                h, ap = int(g["h"]), (g["ap"] or "").replace(".", "")
                if ap and not 1 <= h <= 12:
                    continue
                if ap:
                    h = h % 12 + 12 * (ap == "pm")
                elif g["half"] in ("下午", "晚上") and h < 12 or g["half"] == "中午" and h < 11:
                    h += 12
                elif g["half"] in ("上午", "凌晨") and h == 12:
                    h = 0
                local = datetime(y, mo, d, h, int(g["mi"]), int(g["s"] or 0), int((g["f"] or "0")[:6].ljust(6, "0")))
                stated = None
                if g["zone"]:
                    stated = _offset(g["zone"], zone, local)
                    if stated is None:
                        continue
                out += [(*c[:3], c[3] + _against(o, order)) for c in _instants(fmt + "t", local, stated, zone)]
            except ValueError:
                continue
        return out
    for pattern in _QUARTER:
        if m := pattern.fullmatch(t):
            g = m.groupdict()
            q = int(g["q"]) if g.get("q") else ORDINALS.get(g["o"]) or int(g["o"])
            return [_span("quarter", int(g["y"]), 3 * q - 2, f"{g['y']}-Q{q}")]
    for pattern in _MONTH:
        if m := pattern.fullmatch(t):
            g = m.groupdict()
            if g.get("name") and g["name"] not in MONTHS:
                continue
            y, mo = _year(g["y"]), MONTHS[g["name"]] if g.get("name") else int(g["mo"])
            return [_span("month", y, mo, f"{y:04d}-{mo:02d}")] if 1 <= mo <= 12 else []
    if m := _YEAR.fullmatch(t):
        return [_span("year", int(m["y"]), 1, m["y"])]
    return []


def _step(before: tuple, now: tuple) -> int:
    """What it costs that ``now`` follows ``before``; a value without a time costs nothing on either side."""
    if before[1] is None or now[1] is None:
        return 0
    back = before[1] - now[1]
    return (SWITCH_COST if before[0] != now[0] else 0) + (BACK_COST * min(back, BACK_SPAN_US) // BACK_SPAN_US if back > 0 else 0)


class Viterbi:
    """The cheapest path through the interpretations of one sequence of values, given out as they are decided.

    ``start`` are the costs of reaching the first value's candidates from before, ``end`` takes those of going on from the last's.
    """

    def __init__(self, start: list[int] | None = None):
        self.start = start
        self.pending: list[tuple] = []  # (key, candidates, predecessor of each candidate)
        self.costs: list[int] = []

    def push(self, key, candidates: list[tuple]) -> list[tuple]:
        if not self.pending:
            self.costs = [c[3] + (self.start[i] if self.start else 0) for i, c in enumerate(candidates)]
            self.pending = [(key, candidates, [0] * len(candidates))]
            return []
        last, links, costs = self.pending[-1][1], [], []
        for c in candidates:
            totals = [k + _step(b, c) for k, b in zip(self.costs, last)]
            i = min(range(len(totals)), key=totals.__getitem__)
            links.append(i)
            costs.append(totals[i] + c[3])
        least = min(costs)
        self.pending.append((key, candidates, links))
        self.costs = [c - least for c in costs]
        if links.count(links[0]) == len(links):  # all paths come through one candidate: what stands before is decided
            return self._give(len(self.pending) - 1, links[0])
        if len(self.pending) % 256 == 0:
            states = set(range(len(candidates)))
            for at in range(len(self.pending) - 1, 0, -1):
                states = {self.pending[at][2][k] for k in states}
                if len(states) == 1:
                    return self._give(at, states.pop())
        return []

    def _give(self, upto: int, state: int) -> list[tuple]:
        """The path to ``state`` of the value before place ``upto``; what is given out is let go."""
        out = []
        for key, candidates, links in reversed(self.pending[:upto]):
            out.append((key, candidates[state]))
            state = links[state]
        del self.pending[:upto]
        return out[::-1]

    def end(self, onward: list[int] | None = None) -> list[tuple]:
        """What is still open."""
        if not self.pending:
            return []
        totals = [c + (onward[i] if onward else 0) for i, c in enumerate(self.costs)]
        return self._give(len(self.pending), min(range(len(totals)), key=totals.__getitem__))


class Segment:
    """A stretch of one sequence as a min-plus matrix from the candidates of its first value to those of its last."""

    def __init__(self, candidates: list[tuple]):
        self.first = self.last = candidates
        n = len(candidates)
        self.base = [0] * n
        self.rows = [[c[3] if i == j else None for j, c in enumerate(candidates)] for i in range(n)]

    def push(self, candidates: list[tuple]) -> None:
        steps = [[_step(b, c) for b in self.last] for c in candidates]
        self.rows = [[min(r + s for r, s in zip(row, step) if r is not None) + c[3] for c, step in zip(candidates, steps)] for row in self.rows]
        self.last = candidates
        if len(self.rows) > 1:
            # Once all paths share their tails the rows differ by a constant, and one row stands for all.
            offsets = [row[0] - self.rows[0][0] for row in self.rows]
            if all(x - o == y for row, o in zip(self.rows, offsets) for x, y in zip(row, self.rows[0])):
                self.base, self.rows = [b + o for b, o in zip(self.base, offsets)], self.rows[:1]

    def matrix(self) -> list[list[int | None]]:
        rows = self.rows if len(self.rows) == len(self.base) else self.rows * len(self.base)
        return [[None if x is None else b + x for x in row] for b, row in zip(self.base, rows)]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Per batch the list of (sequence, key, candidates) of its values that state a time."""
    cached = lru_cache(50_000)(interpretations)
    for batch in batches:
        out = []
        for seq, table, key, field, value, zone, order in zip(batch["_seq"], batch["table_name"], batch["row_key"], batch["field"], batch["_value"], batch["_zone"], batch["_order"]):
            if found := cached(value, zone, order):
                out.append((seq, (table, key, field), found))
        yield out


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's first and last sequence as matrices: at most two rows."""
    from pyspark import TaskContext

    first, segment, sequence = None, None, None
    for part in _candidates(batches):
        for seq, _, candidates in part:
            if segment is not None and seq == sequence:
                segment.push(candidates)
            else:
                if segment is not None and first is None:
                    first = (sequence, segment)
                sequence, segment = seq, Segment(candidates)
    rows = [(k, s) for k, s in (first, (sequence, segment)) if s is not None] if first else [(sequence, segment)] if segment else []
    ends = lambda candidates: [[c[0], c[1]] for c in candidates]
    at = TaskContext.get().partitionId()
    yield pd.DataFrame([(at, i, k, json.dumps([ends(s.first), ends(s.last), s.matrix()])) for i, (k, s) in enumerate(rows)], columns=["part", "place", "seq", "segment"])


def compose(rows: list[tuple[int, int, int, str]]) -> dict[int, dict[str, tuple[int, list[int]]]]:
    """For each partition the costs before its first and behind its last sequence, from all partitions' ``_summarise`` rows."""
    chain = sorted((part, place, seq, *json.loads(text)) for part, place, seq, text in rows)
    plus = lambda *x: None if any(v is None for v in x) else sum(x)
    least = lambda values: min((v for v in values if v is not None), default=None)
    out: dict[int, dict[str, tuple[int, list[int]]]] = {}
    reached: list[int] = []
    for k, (part, _, seq, first, _, matrix) in enumerate(chain):
        start = [0] * len(first)
        if k and chain[k - 1][2] == seq:
            start = [least([plus(c, _step(b, f)) for c, b in zip(reached, chain[k - 1][4])]) for f in first]
            out.setdefault(part, {})["before"] = (seq, start)
        reached = [least([plus(a, row[j]) for a, row in zip(start, matrix)]) for j in range(len(matrix[0]))]
    onward: list[int] = []
    for k in range(len(chain) - 1, -1, -1):
        part, _, seq, first, last, matrix = chain[k]
        behind = [0] * len(last)
        if k + 1 < len(chain) and chain[k + 1][2] == seq:
            behind = [least([plus(_step(c, f), b) for f, b in zip(chain[k + 1][3], onward)]) for c in last]
            out.setdefault(part, {})["behind"] = (seq, behind)
        onward = [least([plus(x, b) for x, b in zip(row, behind)]) for row in matrix]
    return out


def _resolver(borders):
    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        mine = borders.value.get(TaskContext.get().partitionId(), {})
        before, behind = mine.get("before", (None, None)), mine.get("behind", (None, None))
        sequence, path = None, None
        columns = ["table_name", "row_key", "field", "normalised", "candidates"]
        rows = lambda decided: [(*k, c[2], n) for (k, n), c in decided if c[2] is not None]
        for part in _candidates(batches):
            out: list[tuple] = []
            for seq, key, candidates in part:
                if path is None or seq != sequence:
                    if path is not None:
                        out += rows(path.end())
                    path = Viterbi(before[1] if sequence is None and seq == before[0] else None)
                    sequence = seq
                out += rows(path.push((key, len(candidates)), candidates))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if path is not None and (out := rows(path.end(behind[1] if sequence == behind[0] else None))):
            yield pd.DataFrame(out, columns=columns)

    return resolve


def time_values(table: DataFrame, name: str, key: str, fields: list[str], source: str, arrival: str) -> DataFrame:
    """The non-null values of ``fields`` with their source and place in its order."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    rows = table.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.col(source).alias("_source"), F.col(arrival).alias("_arrival"), pairs.alias("_p"))
    return rows.select("table_name", "row_key", F.col("_p.field").alias("field"), F.col("_p.value").alias("_value"), "_source", "_arrival").where(F.col("_value").rlike(r"[0-9０-９]"))


def normalise_times(values: DataFrame, zone: Column, order: Column, partitions: int | None = None) -> DataFrame:
    """``table_name, row_key, field, normalised, candidates`` of the rows of ``time_values``; values that state no valid time give no row.

    ``candidates`` counts the interpretations that the pass chose from. Null and blank values give none; repeated rows give one each;
    rows without a source form sequences of their own and are read in UTC unless ``zone`` says otherwise. An empty table
    gives an empty one. The result doesn't depend on the number of ``partitions``.
    """
    rows = values.select(F.xxhash64("table_name", "field", "_source").alias("_seq"), "_arrival", "table_name", "row_key", "field", "_value", zone.alias("_zone"), order.alias("_order"))
    keys = ["_seq", "_arrival", "row_key"]
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    # Written once, so that both passes see the same partitions.
    spread = cut_lineage(spread.sortWithinPartitions(*keys).drop("_arrival"))
    # Two rows a partition, whatever the number of values.
    borders = compose([tuple(r) for r in spread.mapInPandas(_summarise, "part int, place int, seq long, segment string").collect()])
    resolve = _resolver(values.sparkSession.sparkContext.broadcast(borders))
    return spread.mapInPandas(resolve, "table_name string, row_key bigint, field string, normalised string, candidates int")


def all_times(documents: DataFrame, articles: DataFrame, feed: DataFrame, sources: DataFrame) -> DataFrame:
    """``normalise_times`` of all published_at, recorded_at and cod_date values."""
    declared = sources.select(F.col("source_id").alias("_source"), "time_zone", "date_order").dropDuplicates(["_source"])
    values = time_values(documents, "documents", "doc_id", ["published_at"], "source_id", "fetched_at").unionByName(time_values(feed, "project_intel", "record_id", ["recorded_at", "cod_date"], "source_id", "ingested_at"))
    values = values.join(declared, "_source", "left")
    accounts = time_values(articles, "dajiala_article", "article_id", ["published_at"], "account_id", "fetched_at").withColumn("time_zone", F.lit("Asia/Shanghai")).withColumn("date_order", F.lit("ymd"))
    return normalise_times(values.unionByName(accounts), F.col("time_zone"), F.col("date_order"))


def found(documents: DataFrame, articles: DataFrame, feed: DataFrame, sources: DataFrame) -> DataFrame:
    """All published_at, recorded_at and cod_date values in their normal form."""
    return all_times(documents, articles, feed, sources).select("table_name", "row_key", "field", "normalised")
