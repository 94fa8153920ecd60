"""Versions of a vault: compare and swap, snapshots, one writer beside readers, two writers at once."""

import threading

import pytest
from lodestone.operators import mutations as M
from lodestone.operators import tags as T
from lodestone.sources import files
from lodestone.sources.committed import CommittedVault
from lodestone.sources.manifest import Manifest, Stale
from test_vault import vault

PAGES = [("A", "#py and #Go", ["Py"]), ("B", "#PY", ["Go"]), ("C", "no tags", [])]


def test_a_file_is_made_once(spark, tmp_path):
    made = [files.create_once(spark, f"{tmp_path}/x.json", text) for text in ("one", "two")]
    assert made == [True, False] and files.read_text(spark, f"{tmp_path}/x.json") == "one"
    assert files.names(spark, str(tmp_path)) == ["x.json"] and files.names(spark, f"{tmp_path}/none") == []
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create_once(spark, f"{tmp_path}/y.json", str(i)) else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read_text(spark, f"{tmp_path}/y.json") == str(won[0])


def test_compare_and_swap(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.latest() == 0 and m.read() == {}
    assert m.commit(0, {"n": 1}) == 1
    with pytest.raises(Stale):
        m.commit(0, {"n": 2})
    assert m.read() == {"n": 1}
    threads = [threading.Thread(target=lambda: m.update(lambda s: {"n": s["n"] + 1}, tries=100)) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert m.read() == {"n": 9} and m.versions() == list(range(1, 10))


def test_versions(spark, tmp_path):
    kept = CommittedVault(spark, str(tmp_path))
    with pytest.raises(LookupError):
        kept.open()
    assert kept.create(vault(spark, PAGES)) == 1
    with pytest.raises(Stale):
        kept.create(vault(spark, PAGES))
    number, new = kept.mutate(lambda v: M.rename_tag(v, "py", "Rust"))
    assert number == 2 and {r.key for r in T.tag_counts(new).collect()} == {"rust", "go"}
    assert {r.key for r in T.tag_counts(kept.open(1)[1]).collect()} == {"py", "go"}
    # A change that fails or does nothing commits nothing.
    with pytest.raises(M.InvalidTag):
        kept.mutate(lambda v: M.update_tags(v, 1, ["not ok"]))
    assert kept.mutate(lambda v: M.rename_tag(v, "none", "x"))[0] == 2
    # Tables that a change leaves alone are not written again.
    kept.mutate(lambda v: M.update_flags(v, 1, ["gem"], "2024-02-01 10:00:00"))
    two, three = kept.manifest.read(2), kept.manifest.read(3)
    assert two["markdown"] == three["markdown"] and two["tags"] == three["tags"] and two["entries"] != three["entries"]
    gone = kept.manifest.expire()
    assert gone and kept.manifest.versions() == [3] and kept.open()[1].markdown.count() == 3


def test_one_writer_and_four_readers(spark, tmp_path):
    """A rename changes the tag list, the entries and the texts; no reader ever sees some of it only."""
    kept = CommittedVault(spark, str(tmp_path))
    kept.create(vault(spark, PAGES))
    names, faults, stop = ["py", "Rust", "Zig", "Odin"], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                _, v = kept.open()
                listed = {r.normalized for r in v.tags.collect()} - {"go"}
                written = {w for r in v.markdown.collect() for w in r.markdown.lower().replace("#", " ").split()} & {n.lower() for n in names}
                given = {t.lower() for r in v.entries.collect() for t in r.tags} - {"go"}
                if not listed == written == given or len(listed) != 1:
                    faults.append((listed, written, given))
            except Exception as e:
                faults.append(e)

    readers = [threading.Thread(target=read) for _ in range(4)]
    for t in readers:
        t.start()
    for old, new in zip(names, names[1:], strict=False):
        kept.mutate(lambda v, old=old, new=new: M.rename_tag(v, old, new))
    stop.set()
    for t in readers:
        t.join()
    assert not faults and kept.manifest.latest() == len(names)


def test_no_write_is_lost(spark, tmp_path):
    kept = CommittedVault(spark, str(tmp_path))
    kept.create(vault(spark, PAGES))
    faults = []

    def tag(i):
        try:
            kept.mutate(lambda v: M.create_tag(v, f"new{i}")[0])
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=tag, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults and {f"new{i}" for i in range(4)} <= {r.normalized for r in kept.open()[1].tags.collect()}
