"""Embedding providers, and embedding of chunks by task."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from abc import ABC, abstractmethod
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .config import Config
from .errors import ProviderError

QUERY_CACHE = 100


class Provider(ABC):
    """Texts to vectors; the last queries are remembered."""

    batch_size = 200

    def __init__(self) -> None:
        self._recent: OrderedDict[str, list[float]] = OrderedDict()

    @property
    @abstractmethod
    def dimension(self) -> int: ...

    @abstractmethod
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...

    def _query(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]

    def embed_query(self, text: str) -> list[float]:
        if text in self._recent:
            self._recent.move_to_end(text)
        else:
            self._recent[text] = self._query(text)
            if len(self._recent) > QUERY_CACHE:
                self._recent.popitem(last=False)
        return self._recent[text]


class HashingProvider(Provider):
    """Local, without a model: signed hashes of words, their parts and character trigrams, to unit length."""

    def __init__(self, mode: str = "lite"):
        super().__init__()
        self._dimension = {"lite": 384, "quality": 1024}.get(mode, 384)

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for text in texts:
            v = np.zeros(self._dimension)
            for word in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)):
                word = word.lower()
                for weight, part in [(1.0, word), *((0.35, f"#{word}#"[k : k + 3]) for k in range(len(word)))]:
                    h = xxhash.xxh3_64_intdigest(part.encode())
                    v[h % self._dimension] += weight if h >> 63 else -weight
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


class HttpProvider(Provider):
    """A remote service over HTTP; its key comes from the environment."""

    def __init__(self, url: str, model: str, dimension: int | None, key_name: str | None = None, kinds: tuple[str, str] | None = None, single: bool = False):
        super().__init__()
        self.url, self.model, self.key_name, self.kinds, self.single = url, model, key_name, kinds, single
        self._dimension = dimension

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._dimension = len(self.embed_texts(["dimension"])[0])
        return self._dimension

    def _post(self, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.key_name:
            if not os.environ.get(self.key_name):
                raise ProviderError(f"set {self.key_name} to use this provider")
            headers["Authorization"] = f"Bearer {os.environ[self.key_name]}"
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=60) as answer:
                return json.load(answer)
        except OSError as e:
            raise ProviderError(f"{self.url}: {e}") from e

    def _embed(self, texts: list[str], kind: str | None) -> list[list[float]]:
        if self.single:
            return [self._post({"model": self.model, "prompt": t})["embedding"] for t in texts]
        out = []
        for at in range(0, len(texts), self.batch_size):
            body = {"model": self.model, "input": texts[at : at + self.batch_size]} | ({"input_type": kind} if kind else {})
            out += [d["embedding"] for d in self._post(body)["data"]]
        return out

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, self.kinds[0] if self.kinds else None)

    def _query(self, text: str) -> list[float]:
        return self._embed([text], self.kinds[1] if self.kinds else None)[0]


def create(config: Config) -> Provider:
    """The provider that the settings name, sending texts in batches of the configured size."""
    made = _named(config)
    made.batch_size = config.batch_size
    return made


def _named(config: Config) -> Provider:
    name = config.embedding_provider
    if name == "local":
        return HashingProvider(config.embedding_mode)
    if name == "voyage":
        return HttpProvider("https://api.voyageai.com/v1/embeddings", "voyage-code-2", 1536, "VOYAGE_API_KEY", ("document", "query"))
    if name == "openai":
        return HttpProvider("https://api.openai.com/v1/embeddings", "text-embedding-3-small", 1536, "OPENAI_API_KEY")
    if name == "ollama":
        return HttpProvider(os.environ.get("OLLAMA_URL", "http://localhost:11434") + "/api/embeddings", os.environ.get("OLLAMA_MODEL", "nomic-embed-text"), None, single=True)
    raise ProviderError(f"unknown embedding provider {name!r}")


def embed_chunks(chunks: DataFrame, provider: Provider) -> DataFrame:
    """chunks with their content's embedding; each task embeds its own rows, in the provider's batches."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    size = provider.batch_size

    def run(batches):
        for pdf in batches:
            texts = pdf["content"].fillna("").tolist()
            found = [v for at in range(0, len(texts), size) for v in provider.embed_texts(texts[at : at + size])]
            yield pdf.assign(embedding=pd.Series(found, index=pdf.index, dtype=object))

    return chunks.mapInPandas(run, schema)
