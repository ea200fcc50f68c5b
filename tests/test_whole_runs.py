"""Registered queries run their operators on whole tables with default parameters."""

from mzloom.params import Warping
from mzloom.plans import queries


def test_time_maps_take_all_peaks(monkeypatch):
    peaks = object()
    seen = []
    monkeypatch.setattr(queries, "view", lambda spark, sf_dir, name: peaks)
    monkeypatch.setattr(queries.warp, "time_map", lambda *a: seen.append(a) or peaks)
    queries.QUERIES["time_maps"](None, "")
    assert seen == [(peaks, 0, Warping())]
