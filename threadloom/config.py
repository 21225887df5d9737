"""Parameters of the engine and the values they have when nothing is said."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    token_threshold: int = 100_000
    keep_recent: int = 8
    keep_thinking: bool = False
    emergency_margin: int = 10_000
    rewrite_tokens: int = 500
    short_message_tokens: int = 80
    breakpoint_limit: int = 4
    cache_ttl: str = "ephemeral"
    deflation: float = 1.0
    max_messages: int = 10_000
    max_body_bytes: int = 10 * 1024 * 1024
    minimum_run: int = 50

    @property
    def collapse_floor(self) -> int:
        return max(self.token_threshold // 2, 10_000)

    @property
    def pause_minimum(self) -> int:
        return self.token_threshold // 2

    def checked(self) -> EngineConfig:
        """Values out of range go back to what they are by default."""
        d = EngineConfig()
        return EngineConfig(
            **{
                **self.__dict__,
                "token_threshold": self.token_threshold if self.token_threshold >= 1000 else d.token_threshold,
                "keep_recent": self.keep_recent if self.keep_recent >= 0 else d.keep_recent,
                "cache_ttl": self.cache_ttl if self.cache_ttl in ("ephemeral", "1h") else d.cache_ttl,
                "deflation": self.deflation if 0 < self.deflation <= 1 else d.deflation,
                "breakpoint_limit": self.breakpoint_limit if self.breakpoint_limit > 0 else d.breakpoint_limit,
            }
        )
