from types import SimpleNamespace

import pytest

from lexatlas.llm import _work


def session(master, at=None):
    settings = SimpleNamespace(get=lambda name, default=None: at)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: settings), conf=settings)


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            _work.folder(session(master))
        assert _work.folder(session(master, "file:///shared/")) == "file:///shared"
    assert _work.folder(session("local[8]")) == _work.folder(session("local"))
