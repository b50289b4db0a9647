"""Model stages as iterator UDFs: loaded once per worker, with a per-row fallback that is recorded. Without a model the stand-ins are built-in columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import hashing
from .functions import text as T

STUB = "stub"
OBJECTS = "array<struct<label:string,confidence:double,bbox:array<double>>>"
FACES = "array<struct<face_id:string,embedding:array<float>,bbox:array<double>,confidence:double>>"
SCENE = "struct<caption:string,tags:array<string>>"
OCR = "struct<full_text:string,text_blocks:array<string>,has_text:boolean>"


@dataclass(frozen=True)
class Model:
    """``load()`` gives a function of a path (or of a text, for embeddings); ``label`` is recorded for rows it did."""

    load: Callable[[], Callable]
    label: str


@dataclass(frozen=True)
class Models:
    """The plug points. ``objects`` gives (label, confidence, box) lists, ``faces`` (embedding, box, confidence) lists, ``scene`` an answer
    with caption and tags, ``ocr`` a result in any shape that ``text_blocks`` knows, ``embed`` and ``clip`` vectors of texts and
    images, ``clip_text`` those of queries for the clip space. Faces are only looked for where they are enabled."""

    objects: Model | None = None
    faces: Model | None = None
    scene: Model | None = None
    ocr: Model | None = None
    embed: Model | None = None
    clip: Model | None = None
    clip_text: Model | None = None
    enable_faces: bool = False

    def with_faces(self, word: str) -> "Models":
        return replace(self, enable_faces=word.strip().lower() in ("1", "true", "on", "yes"))


def stage(load: Callable[[], Callable[[str], object]], fallback: Callable[[str], object], label: str, kind: str = "string"):
    """A UDF giving struct(value, backend): the model's value, or the fallback's if it can't be loaded or fails on a row."""
    @F.pandas_udf(f"value {kind}, backend string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            model = load()
        except Exception:  # noqa: BLE001 - any failure means the stand-in
            model = None
        for paths in batches:
            rows = []
            for path in paths:
                try:
                    rows.append((model(path), label) if model else (fallback(path), STUB))
                except Exception:  # noqa: BLE001
                    rows.append((fallback(path), STUB))
            yield pd.DataFrame(rows, columns=["value", "backend"])

    return run


#: How a page of recognised text gives its strings, by what kind of thing it is: a mapping names them, a sequence holds (box, (text, confidence)).
SHAPES = (
    (Mapping, lambda page: page.get("rec_texts") or ()),
    (Sequence, lambda page: (line[1][0] for line in page if listed(line, 2) and listed(line[1], 1))),
)


def listed(x, least: int) -> bool:
    return isinstance(x, Sequence) and not isinstance(x, str) and len(x) >= least


def text_blocks(result) -> list[str]:
    """The texts of all pages that aren't empty."""
    shown = (strings(page) for page in result or () for kind, strings in SHAPES if isinstance(page, kind))
    return [str(text) for strings in shown for text in strings if text]


def _seed(path: str) -> int:
    return int(hashlib.sha256(path.encode()).hexdigest()[:8], 16)


def stub_objects(path: str) -> list[dict]:
    n, own = len(hashing.LABELS), _seed(path)
    return [{"label": x, "confidence": 0.9, "bbox": [0.0, 0.0, 100.0, 100.0]} for x in dict.fromkeys((hashing.LABELS[own % n], hashing.LABELS[own // 7 % n]))]


def stub_answer(path: str) -> str:
    caption = hashing.CAPTIONS[_seed(path) % len(hashing.CAPTIONS)]
    return f"caption: {caption}\ntags: {', '.join(caption.split())}"


def both(value: Column, backend: str) -> Column:
    return F.struct(value.alias("value"), F.lit(backend).alias("backend"))


def objects(path: Column, models: Models) -> Column:
    """struct(value, backend) of detected objects."""
    if models.objects is None:
        box = F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0))
        return both(F.transform(hashing.stub_labels(path), lambda x: F.struct(x.alias("label"), F.lit(0.9).alias("confidence"), box.alias("bbox"))), STUB)
    load = models.objects.load

    def own():
        model = load()
        return lambda p: [{"label": str(x), "confidence": float(c), "bbox": [float(v) for v in b]} for x, c, b in model(p)]

    return stage(own, stub_objects, models.objects.label, OBJECTS)(path)


def faces(path: Column, models: Models) -> Column:
    none = F.from_json(F.lit("[]"), FACES)
    if not models.enable_faces:
        return both(none, "disabled")
    if models.faces is None:
        return both(none, STUB)
    load = models.faces.load

    def own():
        model = load()
        return lambda p: [{"face_id": f"{p.rsplit('/', 1)[-1]}#{i}", "embedding": [float(v) for v in e], "bbox": [float(v) for v in b], "confidence": float(c)} for i, (e, b, c) in enumerate(model(p))]

    return stage(own, lambda p: [], models.faces.label, FACES)(path)


def scene(path: Column, models: Models) -> Column:
    if models.scene is None:
        caption = hashing.stub_caption(path)
        return both(F.struct(caption.alias("caption"), F.split(caption, " ").alias("tags")), STUB)
    said = stage(models.scene.load, stub_answer, models.scene.label)(path)
    return F.struct(T.parse_response(said["value"]).alias("value"), said["backend"].alias("backend"))


def ocr(path: Column, models: Models) -> Column:
    if models.ocr is None:
        return both(T.flatten_ocr(F.array().cast("array<string>")), STUB)
    load = models.ocr.load

    def own():
        model = load()
        return lambda p: text_blocks(model(p))

    read = stage(own, lambda p: [], models.ocr.label, "array<string>")(path)
    return F.struct(T.flatten_ocr(read["value"]).alias("value"), read["backend"].alias("backend"))


def embedding(text: Column, models: Models, kind: str = "document") -> Column:
    """Vector of a text; blank texts have none. A model gets the prefix of its kind of text, and there is no fallback: vectors of two models don't compare."""
    if models.embed is None:
        return hashing.hash_embedding(text)
    load = models.embed.load

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(v) for v in model(t)] if t is not None else None for t in texts], dtype=object)

    return run(F.when(~T.is_blank(text), F.concat(F.lit(PREFIXES[kind]), text)))


def pixels(path: Column, models: Models) -> Column:
    """Clip vector of an image; none without a model or for an unreadable image."""
    if models.clip is None:
        return F.lit(None).cast("array<double>")
    return stage(models.clip.load, lambda p: None, models.clip.label, "array<double>")(path)["value"]


def embedding_label(models: Models) -> str:
    return models.embed.label if models.embed else "hash-64"


# What the embedding model expects before queries and passages.
PREFIXES = {"query": "search_query: ", "document": "search_document: "}
