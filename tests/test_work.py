from types import SimpleNamespace

import pytest

from lexatlas.work import settled


def test_a_cluster_must_name_its_shared_folder():
    settings = SimpleNamespace(get=lambda name, default=None: None)
    for master in ("yarn", "local-cluster[3,2,3000]"):
        spark = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: settings), conf=settings)
        with pytest.raises(RuntimeError):
            settled(SimpleNamespace(sparkSession=spark))
