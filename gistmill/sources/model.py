"""A sentence classifier from an ONNX file, as a scorer for the model-based reducer."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

_LOADED: dict[tuple[str, str], tuple] = {}


@dataclass(frozen=True)
class OnnxScorer:
    """Probability of the class ``positive`` for each input; the model is loaded once per Python worker.

    ``model`` is a sequence classifier with inputs among input_ids,
    attention_mask and token_type_ids; ``tokenizer`` a ``tokenizers`` JSON file.
    Both paths must be readable on the executors. Inputs are scored one by one,
    which spares padding to the longest.
    """

    model: str
    tokenizer: str
    positive: int = 1
    max_tokens: int = 512

    def _load(self) -> tuple:
        key = (self.model, self.tokenizer)
        if key not in _LOADED:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = max(2, min(os.cpu_count() or 2, 8))
            session = onnxruntime.InferenceSession(self.model, options, providers=["CPUExecutionProvider"])
            _LOADED[key] = session, Tokenizer.from_file(self.tokenizer), [i.name for i in session.get_inputs()]
        return _LOADED[key]

    def __call__(self, inputs: list[str]) -> list[float]:
        session, tokenizer, names = self._load()
        out = []
        for text in inputs:
            e = tokenizer.encode(text)
            feed = {"input_ids": e.ids, "attention_mask": e.attention_mask, "token_type_ids": e.type_ids}
            logits = session.run(None, {n: np.array([feed[n][: self.max_tokens]], dtype=np.int64) for n in names})[0][0]
            p = np.exp(logits - logits.max())
            out.append(float(p[self.positive] / p.sum()))
        return out
