"""Model weights from files in the safetensors format, by an optional library."""

from __future__ import annotations

import os

import numpy as np


class MissingWeights(FileNotFoundError):
    pass


def load(folder: str, skip: tuple[str, ...] = ("position_ids", ".attn.bias", ".attn.masked_bias")) -> dict[str, np.ndarray]:
    """All tensors of a folder's model.safetensors as 32-bit floats, without buffers that are no weights."""
    if not os.path.isfile(os.path.join(folder, "model.safetensors")):
        raise MissingWeights(f"there is no model.safetensors in {folder}")
    try:
        from safetensors import safe_open
    except ImportError as missing:
        raise MissingWeights("reading weights needs the safetensors library") from missing
    with safe_open(os.path.join(folder, "model.safetensors"), "np") as f:
        return {k: f.get_tensor(k).astype(np.float32) for k in f.keys() if not k.endswith(skip)}  # noqa: SIM118


def encoder(tensors: dict[str, np.ndarray], heads: int = 12) -> dict:
    """An encoder's weights under this engine's names, from the published ones of BERT-like models.

    Published matrices of linear layers are outputs x inputs; here they are inputs x outputs.
    """
    t = {k.removeprefix("bert."): v for k, v in tensors.items()}
    layers = 1 + max(int(k.split(".")[2]) for k in t if k.startswith("encoder.layer."))
    w = {"word": t["embeddings.word_embeddings.weight"], "place": t["embeddings.position_embeddings.weight"], "kind": t["embeddings.token_type_embeddings.weight"], "heads": heads, "layers": layers}
    w["ln.gain"], w["ln.shift"] = t["embeddings.LayerNorm.weight"], t["embeddings.LayerNorm.bias"]
    linear = {"q": "attention.self.query", "k": "attention.self.key", "v": "attention.self.value", "o": "attention.output.dense", "up": "intermediate.dense", "down": "output.dense"}
    for k in range(layers):
        at = f"encoder.layer.{k}"
        for name, theirs in linear.items():
            w[f"{k}.{name}"], w[f"{k}.{name}.bias"] = np.ascontiguousarray(t[f"{at}.{theirs}.weight"].T), t[f"{at}.{theirs}.bias"]
        for name, theirs in (("ln1", "attention.output.LayerNorm"), ("ln2", "output.LayerNorm")):
            w[f"{k}.{name}.gain"], w[f"{k}.{name}.shift"] = t[f"{at}.{theirs}.weight"], t[f"{at}.{theirs}.bias"]
    return w


def decoder(tensors: dict[str, np.ndarray], heads: int = 12) -> dict:
    """A decoder's weights under this engine's names, from the published ones of GPT-2, whose matrices are inputs x outputs."""
    t = {k.removeprefix("transformer."): v for k, v in tensors.items()}
    layers = 1 + max(int(k.split(".")[1]) for k in t if k.startswith("h."))
    w = {"word": t["wte.weight"], "place": t["wpe.weight"], "ln.gain": t["ln_f.weight"], "ln.shift": t["ln_f.bias"], "heads": heads, "layers": layers}
    for k in range(layers):
        for name, theirs in {"qkv": "attn.c_attn", "o": "attn.c_proj", "up": "mlp.c_fc", "down": "mlp.c_proj"}.items():
            w[f"{k}.{name}"], w[f"{k}.{name}.bias"] = t[f"h.{k}.{theirs}.weight"], t[f"h.{k}.{theirs}.bias"]
        for name, theirs in (("ln1", "ln_1"), ("ln2", "ln_2")):
            w[f"{k}.{name}.gain"], w[f"{k}.{name}.shift"] = t[f"h.{k}.{theirs}.weight"], t[f"h.{k}.{theirs}.bias"]
    return w
