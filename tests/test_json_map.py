"""The JSON map as a partitioned source, cut at every byte, against the json module."""

import json
import random

import pytest

from spendlens.sources import files as IO
from spendlens.sources import json_map as J

AWKWARD = {
    "1": "Eating, Places", "2": 'a "quoted" name', "3": "back\\slash\\", "4": "\\\\\"", "5": ":", ",": ",", '","': '":"',
    "6": "", "7": "{ } [ ]", "8": "Grüße, 東京 \U0001f600", "9": "tab\tline\n", "": "empty key", "null": None, "long": "x, " * 300,
    "number": 5, "flag": True, "float": -1.5e3,
}


def plain(found: dict) -> dict:
    return {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in found.items()}


def cut_entries(path: str, edges: list[int]) -> list[tuple]:
    inside, out = False, []
    for lo, hi in zip(edges, edges[1:]):
        out += J.entries(path, lo, hi, inside)
        inside ^= J.count_quotes(path, lo, hi) % 2 == 1
    return out


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_entries_cut_at_every_byte(tmp_path, monkeypatch, ascii_only, block):
    monkeypatch.setattr(J, "BLOCK", block)
    text = json.dumps({k: v for k, v in AWKWARD.items() if k != "long"}, ensure_ascii=ascii_only, indent=1).encode()
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_bytes(b" " + text + b"\n")
    want = list(plain({k: v for k, v in AWKWARD.items() if k != "long"}).items())
    size = len(text) + 2
    for cut in range(1, size):
        got = cut_entries(path, [0, cut, size])
        assert [(k, v) for k, v, _ in got] == want, cut
    for width in (1, 2, 3, 5, 64):
        assert [(k, v) for k, v, _ in cut_entries(path, [*range(0, size, width), size])] == want, width


def test_random_maps(tmp_path):
    rng = random.Random(3)
    for n in range(60):
        made = {"".join(rng.choices('a",:\\{} \n0é', k=rng.randrange(6))): rng.choice(
            [None, 7, False, "".join(rng.choices('a",:\\{}[] \t0é', k=rng.randrange(9)))]) for _ in range(rng.randrange(9))}
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(made, ensure_ascii=False, indent=rng.choice([None, 2])), encoding="utf-8")
        size = path.stat().st_size
        edges = sorted({0, size, *(rng.randrange(size) for _ in range(6))})
        assert {k: v for k, v, _ in cut_entries(str(path), edges)} == plain(made)


def test_read_json_map_in_ranges(spark, tmp_path):
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text(json.dumps(AWKWARD), encoding="utf-8")
    want = plain(AWKWARD)
    for width in (97, J.RANGE_BYTES):
        got = IO.read_json_map(spark, path, "string", "k", "v", width)
        assert got.columns == ["k", "v"] and {r["k"]: r["v"] for r in got.collect()} == want
    (tmp_path / "m.json").write_text('{"1": "a", "2": "b", "1": "c"}')  # the last one counts
    assert {r["id"]: r["description"] for r in IO.read_json_map(spark, path, range_bytes=5).collect()} == {1: "c", 2: "b"}
    (tmp_path / "m.json").write_text(" {} ")
    assert IO.read_json_map(spark, path).count() == 0 and IO.read_json_map(spark, path, range_bytes=1).count() == 0


@pytest.mark.parametrize("text", ['{"1": {"2": "x"}}', '{"1": ["x"]}', '{"1": "x"', '{"1": "x" "2": "y"}', '["x"]', "", '{"1" "x"}',
                                  '{"1": "x",}', '{"1": "x"} {', '{"1": "x'])
def test_anything_else_raises(spark, tmp_path, text):
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text(text)
    for width in (4, 100):
        with pytest.raises(Exception):
            IO.read_json_map(spark, path, range_bytes=width).collect()
