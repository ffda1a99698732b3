"""M1 to M6: adapters of models that aren't part of this package; each loads its library when it is made, once a task."""

from __future__ import annotations

import os


def device(asked: str | None = None, available: tuple[str, ...] = ("gpu", "cpu", "npu")) -> str:
    """M6: the device asked for, or named by LECTERN_DEVICE, gpu if neither is; cpu if it isn't there."""
    name = (asked or os.environ.get("LECTERN_DEVICE", "gpu")).lower()
    return name if name in available else "cpu"


def _need(module: str):
    try:
        return __import__(module)
    except ImportError as e:
        raise ImportError(f"this adapter needs {module}, which isn't installed; pass another callable instead") from e


class SentenceEmbedder:
    """M1: texts to 384 numbers each."""

    def __init__(self, name: str = "all-MiniLM-L6-v2"):
        self.model = _need("sentence_transformers").SentenceTransformer(name, device="cpu" if device() == "cpu" else None)

    def __call__(self, texts):
        return self.model.encode([t or "" for t in texts])


class Seq2Seq:
    """M2: question and context to an answer."""

    def __init__(self, name: str = "google/flan-t5-large", most: int = 128):
        self.run, self.most = _need("transformers").pipeline("text2text-generation", name), most

    def __call__(self, question: str, context: str) -> str:
        return self.run(f"Question: {question}\nContext: {context}\nAnswer:", max_new_tokens=self.most)[0]["generated_text"]


class ImageReader:
    """Bytes of an image to text: up to three attempts of the first reader, of which the first that isn't degenerate counts, else the last."""

    def __init__(self, read, degenerate, attempts: int = 3):
        self.read, self.degenerate, self.attempts = read, degenerate, attempts

    def __call__(self, data: bytes) -> str:
        out = ""
        for k in range(self.attempts):
            out = self.read(data, k < self.attempts - 1)  # the last is greedy
            if not self.degenerate(out):
                return out
        return out


class ImageScanner:
    """Bytes of an image to text by a first reader; where it fails or reads nothing, by the fallback (text recognition and a caption, M4)."""

    def __init__(self, first, fallback):
        self.first, self.fallback = first, fallback

    def __call__(self, data: bytes) -> str:
        try:
            out = self.first(data)
        except Exception:  # noqa: BLE001  any failure of the first reader sends the image to the second
            out = ""
        return out if out and out.strip() else self.fallback(data)


class RecognizerAndCaptioner:
    """Bytes of an image to the text found in it and a caption, each only if it isn't blank."""

    def __init__(self, recognize, caption):
        self.recognize, self.caption = recognize, caption

    def __call__(self, data: bytes) -> str:
        parts = (("Extracted text: ", self.recognize(data)), ("Image description: ", self.caption(data)))
        return "\n\n".join(head + x for head, x in parts if x and x.strip())


class Transcriber:
    """M5: path of a sound file to text."""

    def __init__(self, size: str = "base"):
        self.model = _need("whisper").load_model(size)

    def __call__(self, path: str) -> str:
        return self.model.transcribe(path)["text"]
