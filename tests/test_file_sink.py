"""File operations that are killed, doubled and run again; destinations that are taken."""

import os
import random
import re
import shutil
import threading
from datetime import datetime

import pytest

from eventloom import config as conf
from eventloom.config import Mode
from eventloom.operators import naming
from eventloom.plans import file_plan, file_sink, importing


def operations(spark, rows):
    return spark.createDataFrame(rows, "op string, src string, dst string")


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.jpg").write_text(text)


@pytest.mark.parametrize("op", ["copy", "move"])
def test_taken_names_are_never_overwritten(spark, tmp_path, op):
    a, b = tmp_path / "in", tmp_path / "out"
    put(a, x="new", y="same", z="free")
    put(b, x="old", y="same")
    out = file_sink.carry_out(operations(spark, [(op, f"{a}/{n}.jpg", f"{b}/{n}.jpg") for n in "xyz"] + [(op, f"{a}/gone.jpg", f"{b}/gone.jpg")]), str(b))
    assert (out.done, out.before, out.failed) == (1, 1, 2)
    assert dict(out.failures) == {f"{b}/x.jpg": "destination exists", f"{b}/gone.jpg": "source is missing"}
    assert (b / "x.jpg").read_text() == "old" and (a / "x.jpg").read_text() == "new" and (b / "z.jpg").read_text() == "free"
    assert (a / "z.jpg").exists() == (a / "y.jpg").exists() == (op == "copy")
    assert sorted(os.listdir(b)) == ["x.jpg", "y.jpg", "z.jpg"]  # no parts, no journal


@pytest.mark.parametrize("op", ["copy", "move"])
@pytest.mark.parametrize("at", ["copy2", "link", "unlink"])
def test_killed_anywhere_and_run_again(tmp_path, monkeypatch, op, at):
    """The task dies before or after a step; the next try ends with one whole file."""
    for k, when in enumerate(("before", "after")):
        a, b = tmp_path / f"in{k}", tmp_path / f"out{k}"
        put(a, x="content")
        b.mkdir()
        owner = shutil if at == "copy2" else os
        step = getattr(owner, at)

        def dies(*args, **kw):
            if when == "after":
                step(*args, **kw)
            raise KeyboardInterrupt

        with monkeypatch.context() as m:
            m.setattr(owner, at, dies)
            try:
                file_sink.place(op, f"{a}/x.jpg", f"{b}/x.jpg")
            except KeyboardInterrupt:
                pass
        assert file_sink.place(op, f"{a}/x.jpg", f"{b}/x.jpg") in ("done", "before")
        assert (b / "x.jpg").read_text() == "content" and (a / "x.jpg").exists() == (op == "copy")
        assert [p for p in os.listdir(b) if ".part-" not in p] == ["x.jpg"]


def test_moves_across_file_systems(tmp_path, monkeypatch):
    a, b = tmp_path / "in", tmp_path / "out"
    put(a, x="content", y="content")
    put(b, y="other")
    link = os.link

    def far(source, target, **kw):
        if os.path.dirname(source) != os.path.dirname(target):
            raise OSError(18, "Invalid cross-device link")
        link(source, target, **kw)

    monkeypatch.setattr(os, "link", far)
    assert file_sink.place("move", f"{a}/x.jpg", f"{b}/x.jpg") == "done" and not (a / "x.jpg").exists()
    assert file_sink.place("move", f"{a}/y.jpg", f"{b}/y.jpg") == "destination exists" and (a / "y.jpg").exists()
    assert sorted(os.listdir(b)) == ["x.jpg", "y.jpg"]


@pytest.mark.parametrize("op", ["copy", "move"])
def test_doubled_tasks(tmp_path, op):
    a, b = tmp_path / "in", tmp_path / "out"
    a.mkdir(), b.mkdir()
    names = [f"{i}.jpg" for i in range(150)]
    for n in names:
        (a / n).write_text(n * 50)
    found = []

    def work():
        for n in names:
            try:
                found.append(file_sink.place(op, f"{a}/{n}", f"{b}/{n}"))
            except OSError as e:
                found.append(repr(e))

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert set(found) <= {"done", "before"} and sorted(os.listdir(b)) == sorted(names)
    assert all((b / n).read_text() == n * 50 for n in names) and len(os.listdir(a)) == (150 if op == "copy" else 0)


def test_a_journal_that_was_left_open(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "in", tmp_path / "out"
    put(a, x="1", y="2")
    b.mkdir()
    with monkeypatch.context() as m:
        m.setattr(file_sink, "_run", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            file_sink.carry_out(operations(spark, [("move", f"{a}/{n}.jpg", f"{b}/{n}.jpg") for n in "xy"]), str(b))
    os.link(a / "x.jpg", b / "x.jpg")  # the first file had been placed
    out = file_sink.resume(spark, str(b))
    assert (out.done, out.before, out.failed) == (1, 1, 0) and sorted(os.listdir(b)) == ["x.jpg", "y.jpg"] and not os.listdir(a)
    assert vars(file_sink.resume(spark, str(b))) == vars(file_sink.Outcome())


@pytest.mark.parametrize("restore", [True, False])
def test_imports_leave_what_is_on_disk(spark, tmp_path, restore):
    """A kept name that the target folder holds is skipped, a restored one isn't restored."""
    a, b = tmp_path / "in", tmp_path / "out"
    a.mkdir()
    when = datetime(2020, 1, 10, 14).timestamp()
    for name in ("a (1).jpg", "b (1).jpg", "c.jpg"):
        (a / name).write_text(f"new {name}")
        os.utime(a / name, (when, when))
    config = conf.override(conf.load(True), inbox=a, outbox=b, libraries=[], restore_names=restore, copy=True)
    target = importing.run(spark, config, execute=False).media.first().target_path
    (b / target).mkdir(parents=True)
    for name in ("A.jpg", "a (1).jpg", "C.JPG"):
        (b / target / name).write_text("old")
    (b / "other").mkdir()
    result = importing.run(spark, config)
    plan = {os.path.basename(r.src): (r.op, os.path.basename(r.dst), r.reason) for r in result.plan.filter("op <> 'mkdir'").collect()}
    assert plan == {"a (1).jpg": ("skip", "a (1).jpg", "destination exists"), "c.jpg": ("skip", "c.jpg", "destination exists"), "b (1).jpg": ("copy", "b.jpg" if restore else "b (1).jpg", None)}
    assert {p: (b / target / p).read_text() for p in os.listdir(b / target)} == {"A.jpg": "old", "a (1).jpg": "old", "C.JPG": "old", plan["b (1).jpg"][1]: "new b (1).jpg"}


def resolve(spark, names, taken=()):
    df = spark.createDataFrame([(n, "t") for n in names], "file_name string, target_path string")
    disk = spark.createDataFrame([("t", n) for n in taken], "target_path string, name string")
    return {r.file_name: r.dst_name for r in naming.resolved_names(df, True, disk).collect()}


def test_long_chains_in_few_rounds(spark, monkeypatch):
    chain = ["a" + " (1)" * i + ".jpg" for i in range(400)]
    rounds = []
    write = naming.written
    monkeypatch.setattr(naming, "written", lambda df, name: rounds.append(name) or write(df, name))
    assert resolve(spark, chain[1:]) == {n: chain[i] for i, n in enumerate(chain[1:])}
    assert rounds.count("name-links") <= 11
    assert resolve(spark, chain[1:], ["a.jpg"]) == {n: n for n in chain[1:]}


def test_names_with_disk_against_model(spark):
    plain = lambda n: re.sub(r" \(\d\)(?=\.jpg$)", "", n)
    for seed in range(4):
        rnd = random.Random(seed)
        make = lambda: rnd.choice("abA") + "".join(f" ({rnd.randrange(1, 3)})" for _ in range(rnd.randrange(4))) + ".jpg"
        names, taken = sorted({make() for _ in range(14)}), {make() for _ in range(3)}
        held = {n.lower() for n in taken}
        may, claimed = {}, set()
        for n in sorted(names, key=lambda n: (plain(n) != n, n)):
            key = plain(n).lower()
            may[n] = plain(n) != n and key not in claimed and key not in held
            claimed.add(key)
        moves = lambda n: may[n] and all(moves(o) for o in names if o != n and o.lower() == plain(n).lower())
        assert resolve(spark, names, taken) == {n: plain(n) if moves(n) else n for n in names}
    assert file_plan.TAKEN_REASON and Mode.COPY
