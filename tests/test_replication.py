"""The registered resampling queries ask for all the draws; small counts are for the helpers' own tests."""

from quillmark.operators import inference
from quillmark.plans import style_queries


class Asked(Exception):
    pass


def asked(monkeypatch, name, run):
    def stop(*args, **_):
        raise Asked(*args)

    monkeypatch.setattr(inference, name, stop)
    try:
        run()
    except Asked as x:
        return x.args


def test_all_draws_are_asked_for(spark, sf_dir, monkeypatch):
    assert asked(monkeypatch, "paired_inference", lambda: style_queries.paired_bootstrap(spark, sf_dir))[4:] == (5000, 9999)
    assert asked(monkeypatch, "bootstrap_weights", lambda: style_queries.weighted_bootstrap(spark, sf_dir))[1:] == (5000,)
