import os

import pytest

from tests.test_files import snapshot, tree
from treeline.cli import main


def test_tools(spark, tmp_path, capsys, monkeypatch):
    root, copy = tree(tmp_path / "r"), str(tmp_path / "c")

    def run(*args):
        main(list(map(str, args)), spark)
        return capsys.readouterr().out

    assert run("walk", root, "--print", "--sort", "size", "--file-histogram", "--output", tmp_path / "l").count("\n") > 8
    assert run("find", "--input", tmp_path / "l", "--type", "f", "--size", "+0") == "".join(f"{root}/{p}\n" for p in ("d1/d2/f2", "d1/f1", "f0"))
    assert f"{root}/d1/l\n" in run("find", root, "--type", "l", "--name", "l", "--maxdepth", 2, "--mtime", "-1")
    run("cp", "--preserve", root, copy)
    assert snapshot(copy) == snapshot(root)
    assert "EXIST=DIFFER\t1\t0\n" in run("cmp", root, copy)
    os.unlink(f"{copy}/f0")
    assert "/f0\tcopy" in run("sync", "--dryrun", root, copy)
    run("sync", "--delete", "--contents", root, copy)
    assert snapshot(copy) == snapshot(root)
    assert run("dup", root).count("\n") == 2
    run("chmod", "--mode", "600", "--match", "f0", root)
    assert os.stat(f"{root}/f0").st_mode & 0o777 == 0o600
    run("reln", root, "/new", root)
    assert os.readlink(f"{root}/up") == "/new/d1"
    run("tar", "--create", "-f", tmp_path / "a.tar", "-C", root, root)
    run("tar", "--extract", "-f", tmp_path / "a.tar", "-C", tmp_path / "x")
    assert sorted(snapshot(tmp_path / "x")) == sorted(snapshot(root))
    run("bz2", "--keep", f"{root}/f0")
    os.unlink(f"{root}/f0")
    run("bz2", "--decompress", f"{root}/f0.dbz2")
    assert open(f"{root}/f0").read() == "hello\nworld\n"
    assert "total" in run("du", root) and "world" in run("grep", "wor", f"{root}/f0")
    assert run("bcast", f"{root}/f0") == "f0\n"
    with pytest.raises(SystemExit, match="isn't striped"):  # no layout is made up
        run("stripe", "--report", root)
    monkeypatch.setattr("sys.stdin", iter(["echo one\n", "\n"]))
    assert run("run") == "one\n"
    run("make", "--nitems", 30, "--depth", 2, "--size", 50, tmp_path / "m")
    assert "unlink" in run("rm", "--dryrun", copy)
    run("rm", copy)
    assert not os.path.exists(copy)


def test_sync_refuses_what_would_lose_data(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["sync", str(tmp_path / "none"), str(tmp_path)], spark)
    os.makedirs(tmp_path / "s")
    with pytest.raises(SystemExit):
        main(["sync", str(tmp_path / "s"), str(tmp_path / "a" / "b")], spark)
