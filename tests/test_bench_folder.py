"""Backends over a folder of labelled pictures."""

from codeframes import cli
from codeframes.plans import bench


def perfect():
    return lambda pngs: [(p.split(b"|")[1].decode(), 0.9) for p in pngs]


def lossy():
    return lambda pngs: [(None, 0.1) for _ in pngs]


def failing():
    def read(pngs):
        if b"two" in pngs[0]:
            raise OSError("no network")
        return [("x", 0.5)]

    return read


def broken():
    raise ImportError("no such engine")


def folder(path, n=3):
    for i, name in enumerate(("one", "two", "three")[:n]):
        (path / f"{name}.png").write_bytes(f"{name}|x = {i}".encode())
        (path / f"{name}.txt").write_text(f"x = {i}\n\n")
    (path / "alone.png").write_bytes(b"alone|?")
    return str(path)


BACKENDS = [("lossy", lossy), ("perfect", perfect), ("failing", failing), ("broken", broken)]


def test_failing_backends_are_left_out(spark, tmp_path):
    shown, best, failures = bench.run_folder(spark, folder(tmp_path), BACKENDS)
    assert best == "perfect" and "Winner: perfect  (recommended default, over 3 labeled frame(s))" in shown
    assert [line.split()[0] for line in shown.splitlines()[2:4]] == ["lossy", "perfect"] and "failing" not in shown
    assert failures == [("broken", "one", "ImportError: no such engine"), ("failing", "two", "OSError: no network")]


def test_no_frames_are_no_win(spark, tmp_path):
    shown, best, failures = bench.run_folder(spark, folder(tmp_path, 0), BACKENDS[:2])
    assert best is None and failures == [] and shown.count("0.000") == 6


def test_command(spark, tmp_path, capsys):
    here = "tests.test_bench_folder"
    assert cli.main(["bench", folder(tmp_path), "--backend", f"{here}:perfect", "--backend", f"{here}:failing"]) == 0
    got = capsys.readouterr()
    assert "Winner: tests.test_bench_folder:perfect" in got.out and "left out, as it failed on two: OSError: no network" in got.err
