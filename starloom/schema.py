"""Column names and input schemas shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RatingColumns:
    """Names of the rating columns, so operators fit any rating-like table.

    ``seq`` is a column that orders the ratings totally (a number or a struct); "last wins" and
    neighbour ties are decided by it, never by the physical row order.
    """

    user: str = "user_id"
    item: str = "item_id"
    rating: str = "stars"
    seq: str = "seq"
    fold: str = "fold"

    @property
    def pair(self) -> list[str]:
        return [self.user, self.item]


DEFAULT_COLUMNS = RatingColumns()

# The rating scale.
MIN_STARS = 1.0
MAX_STARS = 5.0

# The 24 business categories with a flag of their own, in feature order.
TOP_CATEGORIES = [
    "restaurants", "food", "nightlife", "bars", "shopping", "beauty & spas", "health & medical",
    "home services", "local services", "automotive", "active life", "event planning & services",
    "coffee & tea", "sandwiches", "american (traditional)", "american (new)", "pizza",
    "breakfast & brunch", "mexican", "italian", "chinese", "japanese", "seafood", "fast food",
]

# The compliment counters summed into one user signal.
COMPLIMENT_KINDS = [
    "hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos",
]
