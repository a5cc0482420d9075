"""SHA-256 with a running state that can be handed from task to task."""

from __future__ import annotations

import ctypes
from functools import cache

_STATE = 112  # bytes of OpenSSL's SHA256_CTX


@cache
def _openssl() -> ctypes.CDLL:
    import _hashlib
    return ctypes.CDLL(_hashlib.__file__)  # the OpenSSL that hashlib itself uses


class RunningSha256:
    """hashlib keeps its state inside the process; this one gives it away."""

    def __init__(self, state: bytes | None = None):
        self._ctx = ctypes.create_string_buffer(state or b"", 2 * _STATE)
        if state is None:
            _openssl().SHA256_Init(self._ctx)

    def update(self, data) -> None:
        data = bytes(data)
        _openssl().SHA256_Update(self._ctx, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self._ctx.raw[:_STATE]

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._ctx.raw, 2 * _STATE)
        _openssl().SHA256_Final(out, last)
        return out.raw.hex()
