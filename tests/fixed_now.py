"""The moment at which test identities are judged."""

from datetime import datetime

NOW = datetime(2026, 6, 13)
