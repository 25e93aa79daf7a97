"""Tables between steps: gone after their scratch, kept where told so."""

from pathlib import Path

from mixframe.llm.blocks import ARROW_LIMIT, mapped, scratch, staged
from mixframe.runtime import shared_folder


def _folders(spark, name):
    return list(Path(shared_folder(spark).removeprefix("file:")).glob(f"{name}-*"))


def test_scratch_removes_all_but_kept_tables(spark):
    with scratch(spark):
        inner = staged(spark.range(5), "scratch-inner")
        kept = staged(inner.selectExpr("id + 1 AS id"), "scratch-kept", keep=True)
        assert len(_folders(spark, "scratch-inner")) == 1
    assert not _folders(spark, "scratch-inner")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert staged(spark.range(2), "scratch-outside").count() == 2
    assert len(_folders(spark, "scratch-outside")) == 1


def test_scratch_removes_after_an_error(spark):
    try:
        with scratch(spark):
            staged(spark.range(1), "scratch-error")
            raise KeyError("x")
    except KeyError:
        pass
    assert not _folders(spark, "scratch-error")


def test_batches_are_bounded_and_a_limit_of_the_session_stays(spark):
    def same(batches):
        yield from batches

    before = spark.conf.get(ARROW_LIMIT, None)
    try:
        spark.conf.set(ARROW_LIMIT, "1m")
        assert mapped(spark.range(3), same, "id bigint").count() == 3
        assert spark.conf.get(ARROW_LIMIT) == "1m"
        spark.conf.unset(ARROW_LIMIT)
        assert mapped(spark.range(3), same, "id bigint").count() == 3
        assert spark.conf.get(ARROW_LIMIT, None) is not None
    finally:
        spark.conf.unset(ARROW_LIMIT) if before is None else spark.conf.set(ARROW_LIMIT, before)
