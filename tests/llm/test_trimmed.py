import re

from meltemi.llm.shared import trimmed


def _held() -> float:
    """MB of this process that are no mapped files."""
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_a_worker_gives_back_what_a_batch_left_free():
    before, last = _held(), []
    for _ in trimmed(range(3)):
        x = [b"x" * (64 << 10) for _ in range(2000)]
        # Allocated last, so it lies above what becomes free.
        last.append(b"x" * (64 << 10))
        assert _held() - before > 100
        del x
    assert _held() - before < 60


def test_batches_pass_in_order():
    assert list(trimmed([3, 1, 2])) == [3, 1, 2] and list(trimmed([])) == []
