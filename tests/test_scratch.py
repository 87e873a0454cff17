"""Scratch tables: what a scope deletes, and that scopes of other threads are left alone."""

import threading

import pytest

from corpusrank.plans.scratch import materialize, scratch_scope
from corpusrank.sources import files


def there(spark, df):
    return files.exists(spark, df._scratch_path)


def test_scopes_nest(spark):
    with scratch_scope(spark) as keep:
        a = materialize(spark.range(3), "a")
        with scratch_scope(spark) as keep_inner:
            b = keep_inner(materialize(spark.range(4), "b"))
            c = materialize(spark.range(5), "c")
        assert there(spark, a) and there(spark, b) and not there(spark, c)
        keep(a)
    assert there(spark, a) and not there(spark, b)
    with pytest.raises(KeyError), scratch_scope(spark):
        d = materialize(spark.range(6), "d")
        raise KeyError
    assert not there(spark, d) and there(spark, materialize(spark.range(7), "e"))


def test_threads_have_scopes_of_their_own(spark):
    opened, made, found = threading.Event(), threading.Event(), {}

    def other():
        assert opened.wait(60)
        found["plain"] = materialize(spark.range(8), "plain")
        with scratch_scope(spark) as keep:
            found["kept"] = keep(materialize(spark.range(9), "kept"))
            made.set()
        made.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch_scope(spark) as keep:
        mine = keep(materialize(spark.range(2), "mine"))
        opened.set()
        assert made.wait(60)
    t.join(60)
    assert [df.count() for df in (mine, found["plain"], found["kept"])] == [2, 8, 9]
