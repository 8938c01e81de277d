"""Elected group labels, expanded choices, merged hints, places and tables published together."""

import pytest
from pyspark.sql import functions as F

from meetloom.operators import layout, slots, timeline
from meetloom.sources import state


def elected(spark, *labels):
    rows = spark.createDataFrame([(1, i, g) for i, g in enumerate(labels)], "meeting_id long, ord long, group_header string")
    got = timeline.elect_groups(rows).collect()
    assert len(got) == len({g for g in labels if g})
    return {r.original: r.simplified for r in got}


def test_group_labels(spark):
    assert elected(spark, "R20", "R20 / AI 9.1. R20 AI/ML", "R20 / Coverage / R20 Coverage", "R20 / ISAC", "6GR / 10.2.1", "6GR / 10.2.1 Waveform", "", None) == {
        "R20": "R20", "R20 / AI 9.1. R20 AI/ML": "R20", "R20 / Coverage / R20 Coverage": "R20", "R20 / ISAC": "R20", "6GR / 10.2.1": "6GR", "6GR / 10.2.1 Waveform": "6GR",
    }
    # one that begins no other label goes under a part that is one; several spellings go under the first
    assert elected(spark, "NTN / R20", "R20", "r20 / x", "AI 7/8 / Maintenance", "Maintenance", "To be assigned by Kim", "Alone / here") == {
        "NTN / R20": "R20", "R20": "R20", "r20 / x": "R20", "AI 7/8 / Maintenance": "Maintenance", "Maintenance": "Maintenance", "To be assigned by Kim": "TBD", "Alone / here": "Alone",
    }
    assert elected(spark, "NTN / R20", "NTN / x", "R20") == {"NTN / R20": "NTN", "NTN / x": "NTN", "R20": "R20"}


def test_groups_and_sessions_choose_what_is_under_them(spark):
    rows = [(1, "A", "9.1, 9.2", "G"), (1, "A", None, "G"), (1, "B", "9.2", ""), (1, "C", None, ""), (1, "D", "9.3", "H"), (2, "E", "9.1", "H"), (2, "F", None, "G")]
    sessions = spark.createDataFrame(rows, "meeting_id long, name string, agenda_item string, group_header string")

    def kept(groups=(), keys=(), ais=()):
        return sorted((r.meeting_id, r["name"], r.agenda_item or "") for r in layout.apply_facets(sessions, list(ais), [], [], groups=list(groups), session_keys=list(keys)).collect())

    both = [(1, "A", ""), (1, "A", "9.1, 9.2"), (1, "B", "9.2")]  # 9.2 is one of A's items
    assert kept(["G"]) == [*both, (2, "F", "")]
    assert kept(["__other__"]) == [(1, "A", "9.1, 9.2"), (1, "B", "9.2"), (1, "C", "")]
    assert kept(keys=["A|G"]) == both
    assert kept(keys=["C|"]) == [(1, "C", "")]
    assert kept(["H"]) == [(1, "D", "9.3"), (2, "E", "9.1")]
    assert kept(ais=["9.3"], keys=["F|G"]) == [(1, "D", "9.3"), (2, "F", "")]
    assert kept() == kept(["G", "H", "__other__"])


def test_hints_of_a_day(spark):
    days = spark.createDataFrame([(m, "Monday", ["A", "B", "C"]) for m in range(5)], "meeting_id long, day string, available array<string>")
    hints = spark.createDataFrame(
        [
            (0, ["B"], ["B", "X", "B"], ["C", "Y"], "X", None),
            (1, None, [], None, None, ["C", "Z"]),
            (2, ["N"], ["N", "A"], None, "A", ["A"]),
            (4, None, ["Q"], ["C"], "C", []),
        ],
        "meeting_id long, all_rooms array<string>, online_rooms array<string>, offline_rooms array<string>, main_room string, breakout_rooms array<string>",
    )
    got = {r.meeting_id: (r.all_rooms, r.online_rooms, r.offline_rooms, r.main_room, r.breakout_rooms) for r in slots.merge_room_hints(days, hints).collect()}
    assert got == {
        0: (["B", "A", "C"], ["B"], ["C"], "B", []),
        1: (["A", "B", "C"], ["A", "B", "C"], [], "A", ["C"]),
        2: (["N", "A", "B", "C"], ["N", "A"], [], "A", ["N"]),
        3: (["A", "B", "C"], ["A", "B", "C"], [], "A", ["B", "C"]),
        4: (["A", "B", "C"], [], ["C"], "C", []),
    }


def test_places(spark):
    places = spark.createDataFrame([("St. Julian's", "Malta", "Europe/Malta"), ("Göteborg", "SE", "Europe/Stockholm"), ("New York", "US", "America/New_York"), ("York", "US", "Else"), ("York", "UK", "Europe/London")], "city string, country string, timezone string")
    lines = ["St Julians, Malta, Apr. 14th ~ 18th, 2026", "göteborg, SE, Feb. 9th", "Greater New York City, US, May 1", "York, UK, May 1", "New York, UK, May 1", "Nowhere, US, May 1", "York", None, "", ", , "]
    rows = spark.createDataFrame([(x,) for x in [*lines, lines[0]]], "location string")
    got = [(r.location, r.timezone) for r in slots.location_zones(rows, places).collect()]
    assert sorted(got) == sorted(zip(lines[:5], ["Europe/Malta", "Europe/Stockholm", "America/New_York", "Europe/London", "Europe/London"], strict=True))


def test_readers_see_all_tables_of_a_version_or_none(spark, tmp_path, monkeypatch):
    path, done = str(tmp_path / "p"), []
    one = spark.createDataFrame([(1, "a"), (2, "b")], "meeting_id long, v string")
    two = spark.createDataFrame([(1, "la"), (2, "lb")], "meeting_id long, v string")

    def seen():
        return [sorted((r.meeting_id, r.v) for r in state.read_published(spark, path, name).collect()) for name in ("one", "two")]

    assert state.publish({"one": one, "two": two}, path, then=lambda: done.append(1)) == 0
    assert seen() == [[(1, "a"), (2, "b")], [(1, "la"), (2, "lb")]]
    broken = two.withColumn("v", F.raise_error(F.lit("lost an executor")).cast("string"))
    with pytest.raises(Exception, match="lost an executor"):
        state.publish({"one": one.withColumn("v", F.lit("new")), "two": broken}, path, then=lambda: done.append(2))
    assert seen() == [[(1, "a"), (2, "b")], [(1, "la"), (2, "lb")]] and done == [1]
    again = one.where("meeting_id = 2").withColumn("v", F.lit("B"))
    assert state.publish({"one": again, "two": two.where("false")}, path) == 1
    assert seen() == [[(1, "a"), (2, "B")], [(1, "la")]]
