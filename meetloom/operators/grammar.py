"""Cell texts to leaf sessions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = "array<struct<name:string,duration_minutes:int,chair:string,group_header:string,specified_start_time:string>>"
_STRUCK = re.compile(r"~~.*?~~", re.DOTALL)
_MINUTES = re.compile(r"^(.*?)\s*\((0*\d{1,9})\)\s*$")
_RANGE = re.compile(r"^(\d{1,2}):(\d{2})\s*[~\-–]\s*(\d{1,2}):(\d{2})$")


#: Label, minutes and explicit time range of a line.
Line = tuple[str, int | None, tuple[str, int] | None]


def _lines(text: str) -> list[Line]:
    """The lines that aren't struck out."""
    out = []
    for raw in _STRUCK.sub("", text).split("\n"):
        line = raw.strip()
        if not line:
            continue
        if m := _RANGE.match(line):
            h1, m1, h2, m2 = map(int, m.groups())
            out.append(("", None, (f"{h1:02d}:{m1:02d}", h2 * 60 + m2 - h1 * 60 - m1)))
        elif m := _MINUTES.match(line):
            out.append((m[1], int(m[2].lstrip("0") or "0"), None))
        else:
            out.append((line, None, None))
    return out


def _headers(lines: list[Line], persons: frozenset[str]) -> list[int | None]:
    """Where the lines of each header end; None for other lines.

    From the last line upwards, what follows a line is known: its next node (past a header's
    own lines), the minutes and nodes from here on (as sums along next nodes), and the nodes
    1, 2, 4 .. further on. A header's end is then found by halving, so n lines take n log n
    steps however they nest.
    """
    n = len(lines)
    ends: list[int | None] = [None] * n
    minutes, nodes = [0] * (n + 1), [0] * (n + 1)
    numbered = [n] * (n + 1)  # the next line with minutes
    steps = [[n] * (n + 1) for _ in range(max(1, n.bit_length()))]
    for at in range(n - 1, -1, -1):
        label, own, times = lines[at]
        numbered[at] = at if own is not None else numbered[at + 1]
        if times:  # no header's lines go past an explicit time: it leads nowhere
            for step in steps:
                step[at] = at
            continue
        if own and not label.startswith("."):
            ends[at] = _end(at, own, minutes, steps)
            if (end := ends[at]) is not None:
                first = numbered[at + 1]
                dotted = first < end and lines[first][0].startswith(".")
                if nodes[at + 1] - nodes[end] < 2 and label not in persons and not dotted:
                    ends[at] = None
        after = ends[at] or at + 1
        minutes[at], nodes[at] = (own or 0) + minutes[after], (own is not None) + nodes[after]
        steps[0][at] = after
        for lower, step in zip(steps, steps[1:], strict=False):
            step[at] = lower[lower[at]]
    return ends


def _end(at: int, need: int, minutes: list[int], steps: list[list[int]]) -> int | None:
    """Where the nodes after line `at` reach exactly the minutes needed."""
    start = last = at + 1
    for step in reversed(steps):
        if minutes[start] - minutes[step[last]] < need:
            last = step[last]
    end = steps[0][last]
    return end if minutes[start] - minutes[end] == need else None


def parse_cell(text: str | None, persons: frozenset[str] = frozenset()) -> list[dict]:
    """Leaf sessions of a cell.

    A numbered line is a header if the lines after it add up to exactly its minutes and these
    are two or more, or one with a leading dot, or the line is a person; lines with a leading
    dot never are. A person's header gives the chair, other headers and unnumbered lines the
    group. An explicit time range makes the next line a session of its length. A number of
    more than nine digits is no duration but part of the label.
    """
    lines = _lines(text or "")
    ends = _headers(lines, persons)
    leaves: list[dict] = []
    # (next line, end, chair, groups, the unnumbered line that counts, explicit time) of the headers around
    around: list[tuple[int, int, str | None, list[str], list[str], tuple[str, int] | None]] = [(0, len(lines), None, [], [], None)]
    while around:
        at, end, chair, groups, own, explicit = around.pop()
        while at < end:
            label, minutes, times = lines[at]
            if times:
                explicit = times
            elif explicit:
                if not label.startswith("."):
                    leaves.append({"name": label, "duration_minutes": explicit[1], "chair": chair, "group_header": " / ".join(groups + own), "specified_start_time": explicit[0]})
                    explicit = None
            elif minutes is None:
                own = [label]
            elif inner := ends[at]:
                person = label in persons
                around.append((inner, end, chair, groups, own, explicit))
                around.append((at + 1, min(inner, end), label if person else chair, groups + own if person else groups + [label], [], None))
                break
            else:
                leaves.append({"name": label.lstrip(".").strip(), "duration_minutes": minutes, "chair": chair, "group_header": " / ".join(groups + own), "specified_start_time": None})
            at += 1
    return leaves


def parse_cells(cells: DataFrame, persons: list[str], text: str = "text") -> DataFrame:
    """cells with a row per leaf session; persons are the known chairs, a short list."""
    known = frozenset(persons)

    @F.pandas_udf(LEAF)
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_cell(t, known))

    return cells.select("*", F.posexplode(leaves(F.col(text))).alias("leaf", "__l")).select("*", "__l.*").drop("__l")
