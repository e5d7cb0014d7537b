from types import SimpleNamespace

from codestrata import session
from codestrata.session import checkpointed


def test_driver_garbage_is_collected_once_the_heap_is_half_of_what_it_may_be(spark, monkeypatch):
    heap, collected, settings = [400], [], {}
    runtime = SimpleNamespace(totalMemory=lambda: heap[0], maxMemory=lambda: 1000)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))), System=SimpleNamespace(gc=lambda: collected.append(heap[0])))
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(conf=lambda: SimpleNamespace(setIfMissing=settings.setdefault))), _jvm=jvm, applicationId="another")
    for size in [400] * 20 + [600] * 20:
        heap[0] = size
        session._spared(context)
    assert settings == {"spark.broadcast.blockSize": session.PIECE} and collected == [600] * -(-20 // (session.SPARED + 1))
    assert checkpointed(spark.range(3)).count() == 3
    assert spark.sparkContext._jsc.sc().conf().get("spark.broadcast.blockSize") == session.PIECE
