"""The command line over a small collection on disk."""

import json

import pytest
import yaml

from inkwell import cli

PLAIN = "the king of the castle and his brother were riding over the hill because you would not do what we could do upon the road while they have your sword "


@pytest.fixture()
def place(tmp_path, spark):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "pool").mkdir()
    for i in range(4):
        (tmp_path / "corpus" / f"c{i}.txt").write_text((PLAIN if i % 2 else PLAIN.replace("you", "he").replace("do", "see")) * (3 + i))
    for i in range(3):
        (tmp_path / "pool" / f"n{i}.txt").write_text(f"foreign text number {i} with the words of another hand " * 9)
    sources = {"texts": [{"id": f"c{i}", "title": f"C {i}", "gutenberg_id": i + 1, "expected_words": 20} for i in range(4)], "noise_pool": [{"id": f"n{i}", "title": "N", "gutenberg_id": 50 + i} for i in range(3)]}
    (tmp_path / "sources.yaml").write_text(yaml.safe_dump(sources))
    sets = {"corpus.dir": "corpus", "corpus.sources": "sources.yaml", "corpus.manifest": "manifest", "noise.pool_dir": "pool", "llm.cache_dir": "cache", "run.out_dir": "runs"}
    own = [x for k, v in sets.items() for x in ("--set", f"{k}={tmp_path / v}")]
    return tmp_path, [*own, "--set", "corpus.expected_count=4", "--set", "chunking.P=40", "--set", "run.M=1", "--set", "llm.concurrency=2"]


def test_settings(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["config", "show", "--preset", "mini"]) == 0
    assert '"P": 120' in capsys.readouterr().out
    assert cli.main(["config", "validate", "--set", "chunking.Q=1"]) == 2


def test_corpus_manifest_and_findings(place, capsys):
    folder, own = place
    assert cli.main(["corpus", "manifest", *own]) == 0 and cli.main(["corpus", "verify", *own]) == 1
    out = capsys.readouterr().out
    assert "missing\tn0" in out and "outside_band\tc0" in out and "total_outside_band\t*" in out
    (folder / "corpus" / "c0.txt").write_text("other words")
    cli.main(["corpus", "verify", *own])
    assert "checksum_drift\tc0" in capsys.readouterr().out


def test_a_run_and_its_resumption(place, capsys):
    folder, own = place
    assert cli.main(["run", *own, "--set", "corpus.include_ids=[c0, zz]"]) == 2
    assert cli.main(["run", "--dry-run", *own]) == 0 and not (folder / "runs").exists()
    assert cli.main(["run", *own, "--out", str(folder / "one")]) == 0
    first = json.loads((folder / "one" / "run.json").read_text())
    assert first["calls"]["live"] > 0 and first["counts"]["n_creations"] == 4 and first["threshold"]["tau"] is not None
    assert cli.main(["run", *own, "--out", str(folder / "two")]) == 0
    second = json.loads((folder / "two" / "run.json").read_text())
    assert second["calls"]["live"] == 0 and second["calls"]["total"] == first["calls"]["total"] and second["threshold"]["tau"] == first["threshold"]["tau"]
    with pytest.raises(FileExistsError):
        cli.main(["run", *own, "--out", str(folder / "two")])
    capsys.readouterr()
    assert cli.main(["cache", "verify", *own]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_entries"] == first["calls"]["live"]


def test_a_comparison(place, capsys):
    folder, own = place
    assert cli.main(["compare", "-m", "fake", "-m", "nobody", "--chunks", "3", *own]) == 0 and "at most 6 calls" in capsys.readouterr().out
    assert cli.main(["compare", "-m", "fake", "-m", "nobody", "--chunks", "3", "--yes", "--out", str(folder / "cmp"), *own]) == 0
    models = {m["model"]: m for m in json.loads((folder / "cmp" / "summary.json").read_text())["models"]}
    assert models["fake"]["n_ok"] == 3 and models["nobody"]["n_ok"] == 0 and list((folder / "cmp" / "rewrites").glob("part-*"))
