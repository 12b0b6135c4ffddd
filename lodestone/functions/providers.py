"""Models behind one interface: local ones held once a worker, remote ones with pauses between attempts.

A model is a callable that takes a list of items and returns one vector each (embedders), or takes a
system text and a text and returns a text (generators). What is here wraps such callables; it is
pickled to the workers, so a wrapper holds how to make a model, not the model.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Answers of a server that are worth another attempt.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504, 529})


class ProviderError(Exception):
    """A failed call; ``status`` is the server's answer, 0 without one."""

    def __init__(self, message: str, status: int = 0, retryable: bool = False) -> None:
        super().__init__(message)
        self.status, self.retryable = status, retryable or status in RETRYABLE


class Unsupported(ProviderError):
    """The provider has no such operation; trying again does not help."""


@dataclass(frozen=True)
class Retry:
    """Attempts with pauses that grow by ``factor``, up to ``longest`` seconds."""

    attempts: int = 5
    first: float = 1.0
    factor: float = 2.0
    longest: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def pauses(self) -> list[float]:
        return [min(self.first * self.factor**k, self.longest) for k in range(self.attempts - 1)]

    def __call__(self, call: Callable[[], object]) -> object:
        """The call's result; what is not worth another attempt is raised at once, the last failure as it is."""
        for pause in [*self.pauses(), None]:
            try:
                return call()
            except ProviderError as e:
                if not e.retryable or pause is None:
                    raise
            except (ConnectionError, TimeoutError) as e:
                if pause is None:
                    raise ProviderError(str(e), retryable=True) from e
            self.sleep(pause)
        raise AssertionError("unreachable")


_HELD: dict[str, object] = {}
_LOCK = threading.Lock()


@dataclass(frozen=True)
class OncePerWorker:
    """A model that each Python worker makes once, under ``name``, and uses from one thread at a time."""

    name: str
    make: Callable[[], Callable]

    def __call__(self, *args: object) -> object:
        with _LOCK:
            if self.name not in _HELD:
                _HELD[self.name] = self.make()
            return _HELD[self.name](*args)


@dataclass(frozen=True)
class Item:
    """What an embedder gets: a text, a picture, or both; queries may be told from documents."""

    text: str | None = None
    image: bytes | None = None
    is_query: bool = False


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    rows = np.asarray(vectors, dtype=np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Checked:
    """An embedder whose answers are checked: one vector an item, else the attempt failed.

    ``query_instruction`` and ``document_instruction`` go before the texts of a batch, which is either all queries or all documents.
    """

    model: Callable[[Sequence[str]], Sequence]
    retry: Retry = field(default_factory=Retry)
    query_instruction: str = ""
    document_instruction: str = ""

    def __call__(self, items: Sequence[str | Item]) -> np.ndarray:
        if not len(items):
            return np.zeros((0, 0))
        texts = [i.text if isinstance(i, Item) else i for i in items]
        if any(t is None for t in texts):
            raise Unsupported("an item without a text")
        asked = isinstance(items[0], Item) and items[0].is_query
        before = self.query_instruction if asked else self.document_instruction

        def call() -> np.ndarray:
            got = self.model([before + t for t in texts])
            if len(got) != len(texts):
                raise ProviderError(f"{len(got)} vectors for {len(texts)} texts", retryable=True)
            return np.asarray(got, dtype=np.float64)

        return self.retry(call)


@dataclass(frozen=True)
class DualEncoder:
    """Texts and pictures in one space; of an item with both the picture counts."""

    text_model: Callable[[Sequence[str]], np.ndarray]
    image_model: Callable[[Sequence[bytes]], np.ndarray]

    def __call__(self, items: Sequence[Item]) -> np.ndarray:
        out: list[np.ndarray | None] = [None] * len(items)
        for kind, model in (("image", self.image_model), ("text", self.text_model)):
            at = [k for k, i in enumerate(items) if out[k] is None and getattr(i, kind) is not None]
            if at:
                for k, v in zip(at, model([getattr(items[k], kind) for k in at]), strict=True):
                    out[k] = np.asarray(v, dtype=np.float64)
        if any(v is None for v in out):
            raise Unsupported("an item without text and picture")
        return normalised(np.stack(out)) if out else np.zeros((0, 0))


def post_json(url: str, headers: dict[str, str], body: dict, timeout: float = 60.0) -> dict:
    """POST a JSON object; failures become errors that say whether another attempt may help."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise ProviderError(f"{url}: {e.code} {e.reason}", e.code) from e
    except urllib.error.URLError as e:
        raise ProviderError(f"{url}: {e.reason}", retryable=True) from e


Post = Callable[[str, dict, dict], dict]


@dataclass(frozen=True)
class RemoteEmbedder:
    """Embeddings by an endpoint of the common ``/embeddings`` form."""

    base: str
    model: str
    key: str = ""
    retry: Retry = field(default_factory=Retry)
    post: Post = post_json

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        def call() -> np.ndarray:
            got = self.post(f"{self.base.rstrip('/')}/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": list(texts)})
            data = got.get("data") or []
            if not data and not got.get("model") and not (got.get("usage") or {}).get("total_tokens"):
                raise ProviderError("an empty answer: the server behind the address failed")
            if len(data) != len(texts):
                raise ProviderError(f"{len(data)} vectors for {len(texts)} texts", retryable=True)
            return np.array([d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))], dtype=np.float64)

        return self.retry(call) if len(texts) else np.zeros((0, 0))


@dataclass(frozen=True)
class RemoteChat:
    """Answers by an endpoint of the common ``/chat/completions`` form, or of the ``/messages`` form."""

    base: str
    model: str
    key: str = ""
    form: str = "chat"
    most_tokens: int = 4096
    retry: Retry = field(default_factory=Retry)
    post: Post = post_json

    def __call__(self, system: str, text: str) -> str:
        base = self.base.rstrip("/")

        def call() -> str:
            if self.form == "messages":
                got = self.post(f"{base}/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": self.most_tokens, "system": system, "messages": [{"role": "user", "content": text}]})
                parts = [p.get("text", "") for p in got.get("content") or [] if p.get("type", "text") == "text"]
            else:
                got = self.post(f"{base}/chat/completions", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "max_tokens": self.most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}]})
                parts = [(c.get("message") or {}).get("content") or "" for c in (got.get("choices") or [])[:1]]
            if not parts:
                raise ProviderError("an answer without choices", retryable=True)
            return "".join(parts)

        return self.retry(call)
