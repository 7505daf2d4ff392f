"""Walking bouts by any rules: rules that delay the start, end a bout or void it.

The default rules need no Python (``bouts.assemble_bouts``); this engine is for
others.  One recording's strides meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Strides = list[dict]


@dataclass(frozen=True)
class Move:
    """What a rule wants: a later first stride, or the bout's last stride and where the next search begins."""

    start: int | None = None
    last: int | None = None
    restart: int | None = None


class Rule:
    """Both sides of a rule; a subclass overrides one or both.

    step is asked for every stride ``at`` that would join the bout searched for
    from ``first`` on (which so far starts at ``start``), and once more with
    at = len(strides), behind the last one.
    """

    def step(self, strides: Strides, first: int, start: int, at: int, sampling_rate_hz: float) -> Move:
        return Move()

    def accepts(self, strides: Strides, sampling_rate_hz: float) -> bool:
        return True


@dataclass(frozen=True)
class MaxBreak(Rule):
    """Ends a bout where the next stride starts over max_break_s behind the end of the last one.

    trim leaves out strides at the end: "last" the last one, "per_foot" the
    last one of each foot (two if the last two are of different feet, else
    one; of up to two strides the first stays).  end_is_break: the end of the
    strides counts as a break, so that the last bout is trimmed too.
    """

    max_break_s: float
    trim: str | None = None
    end_is_break: bool = True
    foot: str = "lr_label"

    def __post_init__(self):
        if self.max_break_s < 0 or self.trim not in (None, "last", "per_foot"):
            raise ValueError("max_break_s can't be negative; trim is None, last or per_foot")

    def step(self, strides: Strides, first: int, start: int, at: int, sampling_rate_hz: float) -> Move:
        if at == len(strides):
            over = self.end_is_break
        else:
            over = at > first and (strides[at]["start"] - strides[at - 1]["end"]) / sampling_rate_hz > self.max_break_s
        if not over:
            return Move()
        last = at - 1
        if self.trim == "last":
            last -= 1
        elif self.trim == "per_foot":
            if last - first < 2:
                return Move(last=first, restart=at)
            feet = strides[last][self.foot], strides[last - 1][self.foot]
            last -= 2 if all(feet) and feet[0] != feet[1] else 1
        return Move(last=last, restart=at)


@dataclass(frozen=True)
class MinStrides(Rule):
    """Keeps bouts of enough strides: the first given of all, left and right decides; none given voids every bout."""

    strides: int | None = None
    left: int | None = None
    right: int | None = None
    foot: str = "lr_label"

    def __post_init__(self):
        if any(n is not None and n < 0 for n in (self.strides, self.left, self.right)):
            raise ValueError("numbers of strides can't be negative")

    def accepts(self, strides: Strides, sampling_rate_hz: float) -> bool:
        if self.strides is not None:
            return len(strides) >= self.strides
        for side, least in (("left", self.left), ("right", self.right)):
            if least is not None:
                # a foot without any stride never has enough
                return 0 < (held := sum(s[self.foot] == side for s in strides)) >= least
        return False


@dataclass(frozen=True)
class Alternating(Rule):
    """Ends a bout before a stride of the same foot as the last one."""

    foot: str = "lr_label"

    def step(self, strides: Strides, first: int, start: int, at: int, sampling_rate_hz: float) -> Move:
        if not first < at < len(strides):
            return Move()
        before, now = strides[at - 1][self.foot], strides[at][self.foot]
        return Move(last=at - 1, restart=at) if before and before == now else Move()


@dataclass(frozen=True)
class Summary(Rule):
    """Keeps bouts of which a number lies between thresholds, open at the lower and closed at the upper end unless told."""

    summary: Callable[[Strides, float], float]
    lower: float | None = None
    upper: float | None = None
    inclusive: tuple[bool, bool] = (False, True)

    def accepts(self, strides: Strides, sampling_rate_hz: float) -> bool:
        value = self.summary(strides, sampling_rate_hz)
        above = self.lower is None or value > self.lower or self.inclusive[0] and value == self.lower
        below = self.upper is None or value < self.upper or self.inclusive[1] and value == self.upper
        return above and below


#: Reason of the bout that the end of the strides ends.
END_OF_LIST = "end_of_list"


def walk(strides: Strides, rules: dict[str, Rule], sampling_rate_hz: float) -> list[tuple[int, int, int, int, str, str | None]]:
    """(first, start, last, restart, end rule, delay rule) of the searches for a bout, one behind the other.

    Of the rules that delay the start the latest start counts, of those that
    end the bout the earliest end; equal ones in the order of the rules.
    """
    out, first = [], 0
    while first < len(strides):
        start, delay, ended = first, None, None
        for at in range(first, len(strides) + 1):
            moves = [(name, rule.step(strides, first, start, at, sampling_rate_hz)) for name, rule in rules.items()]
            ends = [(m.last, name, m.restart if m.restart is not None else at) for name, m in moves if m.last is not None]
            if ends:
                ended = min(ends, key=lambda e: e[0])
                break
            starts = [(m.start, name) for name, m in moves if m.start is not None]
            if starts:
                start, delay = max(starts, key=lambda s: s[0])
        last, why, restart = ended or (len(strides) - 1, END_OF_LIST, len(strides))
        restart = max(restart, first + 1)
        out.append((first, start, last, restart, why, delay))
        first = restart
    return out


def assemble_by_rules(strides: DataFrame, by: list[str], rules: dict[str, Rule], sampling_rate_hz: float) -> DataFrame:
    """strides with their bouts by rules, in (start, end) order within each recording.

    Adds pre_bout (number of the bout before any is voided; NULL for strides
    between bouts), wb_id (NULL in voided bouts), end_rule (what ended the
    bout, or left the stride out behind it), exclude_rule (what voided the
    bout or left the stride out before it).  Columns of these names are
    replaced.
    """
    own = [f for f in strides.schema.fields if f.name not in ("pre_bout", "wb_id", "end_rule", "exclude_rule")]
    names = [f.name for f in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", pre_bout bigint, wb_id bigint, end_rule string, exclude_rule string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        records = rows.sort_values(["start", "end"], kind="stable").to_dict("records")
        marks: list[tuple] = [(None, None, None, None)] * len(records)
        number = kept = 0
        for first, start, last, restart, why, delay in walk(records, rules, sampling_rate_hz):
            if start > last:  # ended before it began
                marks[first : last + 1] = [(number, None, why, delay)] * (last + 1 - first)
            else:
                members = records[start : last + 1]
                bad = next((name for name, rule in rules.items() if not rule.accepts(members, sampling_rate_hz)), None)
                marks[start : last + 1] = [(number, None if bad else kept, why, bad)] * len(members)
                kept += bad is None
                marks[first:start] = [(None, None, None, delay)] * (start - first)
                marks[last + 1 : restart] = [(None, None, why, None)] * len(marks[last + 1 : restart])
            number += 1
        out = pd.DataFrame(records, columns=names)
        more = pd.DataFrame(marks, columns=["pre_bout", "wb_id", "end_rule", "exclude_rule"]).astype({"pre_bout": "Int64", "wb_id": "Int64"})
        return pd.concat([out, more], axis=1)

    return strides.select(*names).groupBy(*by).applyInPandas(run, schema)
