"""Settings of the engine: frozen defaults, over which what is stored wins, key by key."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # The defaults.
    engineLane: str = "managed"
    localEndpoint: str = "http://localhost:11434"
    managedModel: str = "gemini-2.5-flash-lite"
    ingestion: str = "keyframes_vtt"
    escalateNative: bool = False
    placesEnabled: bool = False
    placesKey: str | None = None
    concurrency: int = 2
    autonomousCapture: bool = False

    def merged(self, patch: dict) -> Settings:
        """These settings with those of the patch; keys that are no setting are left out."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in patch.items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def load(stored: str | None) -> Settings:
    """Settings of a stored JSON object, or of none."""
    return Settings().merged(json.loads(stored) if stored else {})
