from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartlore.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        app="cartlore-tests",
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    clear_scratch(session)
    session.stop()


REVIEW_ROWS = [
    ("AE22NQ", "B07XJ8C8F5", 5.0, None, "Works perfectly, love it", 3, 1609459200000, True, "Electronics"),
    ("AE22NQ", "B09K3M2P1Q", 4.0, None, "Solid build quality", 1, 1612137600000, True, "Electronics"),
    ("AE22NQ", "B08N5WRWNW", 2.0, None, "Broke after 2 weeks", 0, 1614556800000, True, "Home_and_Kitchen"),
    ("BKRMX7", "B07XJ8C8F5", 3.0, None, "Nothing special", 0, 1611014400000, True, "Electronics"),
    ("BKRMX7", "B09K3M2P1Q", 5.0, None, "Best purchase this year", 7, 1613692800000, True, "Electronics"),
]
REVIEW_SCHEMA = (
    "user_id string, parent_asin string, rating double, title string, text string, helpful_vote int, "
    "timestamp long, verified_purchase boolean, category string"
)


@pytest.fixture(scope="session")
def golden_reviews(spark):
    from cartlore.sources.reviews import to_review_events

    return to_review_events(spark.createDataFrame(REVIEW_ROWS, REVIEW_SCHEMA))
