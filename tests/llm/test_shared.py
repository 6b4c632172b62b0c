"""Memory is given back when a task's rows are through, or no more are wanted."""

import pytest

from notewright.llm import shared


def test_memory_is_released_at_the_end_of_a_task(monkeypatch):
    times = []
    monkeypatch.setattr(shared, "release", lambda: times.append(1))
    rows = shared.released(lambda batches: (b + 1 for b in batches))
    assert list(rows(iter([1, 2]))) == [2, 3] and len(times) == 1
    early = rows(iter([1, 2]))
    assert next(early) == 2 and len(times) == 1
    early.close()
    assert len(times) == 2
    with pytest.raises(ZeroDivisionError):
        list(shared.released(lambda batches: (1 // b for b in batches))(iter([0])))
    assert len(times) == 3


def test_release_can_be_called_again_and_again():
    shared.release()
    shared.release()
