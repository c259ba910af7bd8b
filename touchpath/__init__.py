"""touchpath: customer-journey attribution as Spark DataFrame transformations."""

from touchpath.plans.journey import Journey, JourneyConfig

__all__ = ["Journey", "JourneyConfig"]
