"""Memory of Python processes that work for one operator after the other."""

from indexward.llm import common, piece_prefix


def test_memory_goes_back_when_another_operator_begins(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_owner", None)
    monkeypatch.setattr(common, "_give_back", lambda: calls.append("back"))
    common.remembers("one", lambda: calls.append("forgot"))
    common.remembers("one", lambda: calls.append("forgot"))
    assert calls == []
    common.remembers("two")
    assert calls == ["forgot", "back"]


def test_memory_can_be_given_back():
    common._give_back()


def test_segments_that_are_kept_are_few():
    assert piece_prefix.REMEMBERED <= 200_000
