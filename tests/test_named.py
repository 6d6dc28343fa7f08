"""Files with names of their own, and files hashed in pieces."""

import hashlib
import json
import os
import tracemalloc

import pytest

from filmspark.operators import resume as W
from filmspark.sources import files as SF
from filmspark.sources import manifests as M
from filmspark.sources.named import file_sha256, write_named


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))


def test_signatures_beside_their_outputs(spark, tmp_path):
    root = str(tmp_path / "out put")
    rows = [("a/x.mp4", '{"b": [1, {"z": "é"}], "a": null}'), ("a/y+1.png", "{}"), ("film %20.mov", '"text"'), (None, "{}"), ("bad", "{no"), ("a/x.mp4.gone", None)]
    sigs = spark.createDataFrame(rows, "path string, signature string").repartition(3)
    SF.write_signature_files(sigs, root)
    assert listed(root) == ["a/x.mp4.sig.json", "a/y+1.png.sig.json", "film %20.mov.sig.json"]
    with open(f"{root}/a/x.mp4.sig.json", encoding="utf-8") as f:
        assert f.read() == json.dumps({"b": [1, {"z": "é"}], "a": None}, indent=2, ensure_ascii=False) + "\n"
    got = {r.path: json.loads(r.signature) for r in SF.read_signatures(spark, root, root=root).collect()}
    assert got == {p: json.loads(s) for p, s in rows[:3]}
    # write, read and match; then one is replaced, and nothing else is touched
    files = spark.createDataFrame([(p,) for p, _ in rows[:3]], "path string")
    match = lambda: {r.path: r.matches for r in W.signature_match(sigs.where("path is not null and signature is not null"), SF.read_signatures(spark, root, root=root), files).collect()}
    assert {k: v for k, v in match().items() if k != "bad"} == dict.fromkeys(got, True)
    (tmp_path / "out put" / "a" / "x.mp4").write_text("video")
    SF.write_signature_files(spark.createDataFrame([("a/x.mp4", '{"a": 2}')], "path string, signature string"), root)
    assert match()["a/x.mp4"] is False and match()["a/y+1.png"] is True
    assert listed(root) == ["a/x.mp4", "a/x.mp4.sig.json", "a/y+1.png.sig.json", "film %20.mov.sig.json"]


def test_named_files_stay_below_their_root(spark, tmp_path):
    with pytest.raises(Exception, match="is not below"):
        write_named(spark.createDataFrame([("../up.txt", "x")], "path string, text string"), str(tmp_path / "r"))
    write_named(spark.createDataFrame([], "path string, text string"), str(tmp_path / "r"))
    assert listed(tmp_path) == []


def test_manifests_by_name(spark, tmp_path):
    root = str(tmp_path / "m")
    columns = "video_id long, shot_index long, end_seconds double, enabled string, source_reference string, color_reference string, prompt string, fade_to_next string, crossfade_seconds string, extra map<string,string>"
    rows = spark.createDataFrame([(1, 0, 1.5, "true", "s", "", "p", "", "", {"zeta": "1", "alpha": "2"}), (1, 1, 9.0, "no", "", "", "a,b", "", "", {"zeta": "3", "new": "4"}), (2, 0, 2.0, "", "", "", "", "", "", {})], columns)
    videos = spark.createDataFrame([(1, "in/a.mp4", 4.0, "a/refs.csv"), (2, "in/b.mp4", 2.0, "b.csv"), (3, "in/c.mp4", 1.0, "c.csv")], "video_id long, source string, duration double, manifest string")
    M.write_shot_manifest_files(rows, videos, root)
    assert listed(root) == ["a/refs.csv", "b.csv"]
    with open(f"{root}/a/refs.csv", newline="") as f:
        text = f.read()
    # columns that aren't known keep their order, new ones follow
    assert text.splitlines()[1].endswith("crossfade_seconds,zeta,alpha,new") and text.splitlines()[3].endswith(",3,,4") and text.endswith("\n") and not text.endswith("\n\n")
    again = M.read_shot_manifests(spark, f"{root}/a/refs.csv").orderBy("row_index").collect()
    assert [(r.source_video, r.end, r.prompt, r.extra) for r in again] == [("in/a.mp4", "0:00:01.500", "p", {"zeta": "1", "alpha": "2", "new": ""}), ("in/a.mp4", "0:00:04", "a,b", {"zeta": "3", "alpha": "", "new": "4"})]
    chunks = spark.createDataFrame([(1, 1, "7"), (1, 0, "5")], "video_id long, chunk_index long, seed string")
    M.write_chunk_manifest_files(chunks, videos, root)
    assert [(r.chunk_index, r.seed) for r in M.read_chunk_manifests(spark, f"{root}/a/refs.csv").orderBy("chunk_index").collect()] == [(0, "5"), (1, "7")]


def test_files_are_hashed_in_pieces(spark, tmp_path):
    data = {"big.bin": os.urandom(1 << 20) * 48, "empty.bin": b"", "sub dir/é.bin": b"abc"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = SF.fingerprint_files(spark, [f"{tmp_path}/*.bin", str(tmp_path / "sub dir")]).collect()
    assert sorted((r.size, r.sha256, r.mtime_ns) for r in got) == sorted((len(c), hashlib.sha256(c).hexdigest(), (tmp_path / n).stat().st_mtime_ns) for n, c in data.items() if c)
    tracemalloc.start()
    file_sha256(str(tmp_path / "big.bin"))
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_white_space_of_unicode(spark):
    from pyspark.sql import functions as F

    from filmspark.functions.prompts import compact_description

    texts = ["a  b c", "a　b \tc", " x y ", "plain text"]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(compact_description(F.col("t")).alias("d")).collect()]
    assert got == ["a b c", "a b c", "x y", "plain text"]
