"""Nested cell texts: against a plain recursion, and long ones."""

import random
import time

from meetloom.operators import grammar
from meetloom.operators.grammar import parse_cell


def recursive(text: str, persons: frozenset[str]) -> list[dict]:
    """The definition, by recursion over all that may follow."""
    lines = grammar._lines(text)
    leaves: list[dict] = []

    def total(at, need):
        got, nodes = 0, 0
        while at < len(lines) and got < need:
            if lines[at][2]:
                return None
            end = at + 1
            if lines[at][1] is not None:
                got, nodes, end = got + lines[at][1], nodes + 1, header(at) or end
            at = end
        return (nodes, at) if got == need else None

    def header(at):
        label, minutes, _ = lines[at]
        if label.startswith(".") or not minutes:
            return None
        found = total(at + 1, minutes)
        if not found:
            return None
        first = next((x for x in lines[at + 1 : found[1]] if x[1] is not None), None)
        return found[1] if found[0] >= 2 or label in persons or (first and first[0].startswith(".")) else None

    def leaf(name, minutes, chair, groups, start):
        leaves.append({"name": name, "duration_minutes": minutes, "chair": chair, "group_header": " / ".join(groups), "specified_start_time": start})

    def walk(at, end, chair, groups):
        own, explicit = [], None
        while at < end:
            label, minutes, times = lines[at]
            if times:
                explicit = times
            elif explicit:
                if not label.startswith("."):
                    leaf(label, explicit[1], chair, groups + own, explicit[0])
                    explicit = None
            elif minutes is None:
                own = [label]
            elif inner := header(at):
                walk(at + 1, min(inner, end), label if label in persons else chair, groups + own if label in persons else groups + [label])
                at = inner
                continue
            else:
                leaf(label.lstrip(".").strip(), minutes, chair, groups + own, None)
            at += 1

    walk(0, len(lines), None, [])
    return leaves


def test_small_texts_against_recursion():
    rng = random.Random(6)
    persons = frozenset({"Kim", "Ann"})
    for _ in range(6000):
        lines = []
        for _ in range(rng.randrange(0, 14)):
            label = rng.choice(["Kim", "Ann", "x", "y z", ".sub", "6GR"])
            minutes = rng.choice([0, 10, 10, 20, 20, 30, 40, 60, 120])
            lines.append(rng.choice([f"{label} ({minutes})"] * 6 + [label, f"~~{label} (30)~~", "13:00 ~ 14:30", ""]))
        text = "\n".join(lines)
        assert parse_cell(text, persons) == recursive(text, persons), text


def test_long_texts_take_n_log_n():
    n = 10_000
    halving = "\n".join(f"x ({2 ** max(0, 29 - i)})" for i in range(n))
    nested = "\n".join("Kim (30)" for _ in range(n - 1)) + "\n.end (30)"
    flat = f"all ({n * 10})\n" + "\n".join("x (10)" for _ in range(n))
    began = time.process_time()
    assert len(parse_cell(halving)) > 0
    assert parse_cell(nested, frozenset({"Kim"})) == [{"name": "end", "duration_minutes": 30, "chair": "Kim", "group_header": "", "specified_start_time": None}]
    assert len(parse_cell("\n".join("x (30)" for _ in range(n)))) == n
    leaves = parse_cell(flat)
    assert len(leaves) == n and {x["group_header"] for x in leaves} == {"all"}
    assert time.process_time() - began < 4


def test_numbers_that_are_no_duration(spark):
    cells = spark.createDataFrame([(1, "x (99999999999)\ny (30)"), (2, f"a ({'9' * 5000})"), (3, f"b ({'0' * 5000}20)"), (4, None), (5, "c (999999999)")], "id int, text string")
    rows = {(r.id, r.name): (r.duration_minutes, r.group_header) for r in grammar.parse_cells(cells, []).collect()}
    assert rows == {(1, "y"): (30, "x (99999999999)"), (3, "b"): (20, ""), (5, "c"): (999999999, "")}
