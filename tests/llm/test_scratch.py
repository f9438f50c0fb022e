"""The shared folder: the session's own, a temporary one on a laptop, none on a cluster."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidespan.llm import scratch


def session(master, told=None):
    conf = SimpleNamespace(get=lambda k, d=None: told)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k, d=None: None), master=master, applicationId=f"app-{master}"))


def test_shared_folder():
    assert scratch.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    at = scratch.shared_dir(session("local[2]"))
    assert at.startswith("file://") and scratch.shared_dir(session("local[2]")) == at
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master))
