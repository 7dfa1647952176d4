"""Clients of embedding endpoints: requests, answers, retries and the breaker."""

import dataclasses
import json
import threading

import pytest

from lodestone.operators.embedding import Endpoint, Guarded, HashEmbedder, Refused, Unavailable, embedded, vectors_of
from lodestone.operators.registry import EmbeddingModel

MODEL = EmbeddingModel("m", "tei", "id", "http://in/", "http://ask", 2, truncate_chars=3)


@pytest.mark.parametrize(("provider", "url", "body"), [("tei", "http://in/embed", {"inputs": ["abc", "d"]}), ("ollama", "http://in/api/embed", {"input": ["abc", "d"], "model": "id"}), ("openai", "http://in/v1/embeddings", {"input": ["abc", "d"], "model": "id"})])
def test_requests(provider, url, body):
    sent = []
    client = Endpoint(dataclasses.replace(MODEL, provider=provider), key="k", send=lambda *x: sent.append(x) or (200, b"[[1, 2], [3, 4]]"))
    assert client(["abcdef", "d"]) == [[1.0, 2.0], [3.0, 4.0]] and client([]) == []
    assert len(sent) == 1 and sent[0][0] == url and json.loads(sent[0][1]) == body and ("Authorization" in sent[0][2]) == (provider == "openai")
    assert Endpoint(MODEL, "query").url == "http://ask/embed"
    with pytest.raises(ValueError):
        Endpoint(MODEL, "other")


def test_answers():
    two = [[1.0, 2.0], [3.0, 4.0]]
    assert vectors_of([[1, 2], [3, 4]]) == vectors_of({"embeddings": [[1, 2], [3, 4]]}) == vectors_of({"data": [{"embedding": [1, 2]}, {"embedding": [3, 4]}]}) == two
    for bad in ({"data": [1]}, {"data": [{"vector": []}]}, [1, 2], [["a"]], "x", None, {"odd": 1}, [[True]]):
        with pytest.raises(Refused):
            vectors_of(bad)
    with pytest.raises(Refused, match="too long"):
        vectors_of({"error": {"message": "too long"}})


@pytest.mark.parametrize(("status", "body", "error"), [(429, b"", Unavailable), (503, b"", Unavailable), (400, b"bad", Refused), (500, b"x", Refused), (200, b"{broken", Unavailable)])
def test_faults(status, body, error):
    with pytest.raises(error):
        Endpoint(MODEL, send=lambda *_: (status, body))(["a"])


def test_pauses_double_and_vary():
    waits, answers = [], [Unavailable(), Unavailable(), [[1.0, 2.0]]]

    def call(_):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert Guarded(call, 2, pause=waits.append, chance=lambda: 0.5)(["a"]) == [[1.0, 2.0]] and waits == [0.625, 1.25]
    tries = []
    with pytest.raises(Refused):
        Guarded(lambda _: tries.append(1) or (_ for _ in ()).throw(Refused()), 2)(["a"])
    assert len(tries) == 1


def test_one_caller_tries_after_the_cooldown():
    now, entered, leave = [0.0], threading.Event(), threading.Event()

    def call(_):
        if now[0] < 50:
            raise Unavailable("down")
        entered.set()
        leave.wait(10)
        return [[1.0, 2.0]]

    guard = Guarded(call, 2, threshold=2, cooldown=30, pause=lambda _: None, clock=lambda: now[0])
    with pytest.raises(Unavailable):
        guard(["a"])
    now[0] = 29
    with pytest.raises(Unavailable, match="open"):
        guard(["a"])
    now[0] = 31  # a try that fails opens it again
    with pytest.raises(Unavailable, match="down"):
        guard(["a"])
    now[0] = 60
    with pytest.raises(Unavailable, match="open"):
        guard(["a"])
    now[0] = 62
    got = []
    thread = threading.Thread(target=lambda: got.append(guard(["a"])))
    thread.start()
    assert entered.wait(10)
    with pytest.raises(Unavailable, match="open"):
        guard(["b"])  # while the first one tries
    leave.set()
    thread.join()
    assert got == [[[1.0, 2.0]]] and guard(["c"]) == [[1.0, 2.0]]


def test_a_model_bounds_and_guards(spark):
    d = spark.createDataFrame([(i, "word " * 9) for i in range(7)], "id int, text string")
    rows = embedded(d, lambda: HashEmbedder(2), model=dataclasses.replace(MODEL, batch_size=2, truncate_chars=0)).collect()
    assert len(rows) == 7 and all(len(r["embedding"]) == 2 for r in rows)
    with pytest.raises(Exception, match="expected"):
        embedded(d, lambda: HashEmbedder(3), model=MODEL).collect()
