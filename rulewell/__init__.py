"""rulewell: community-rule moderation data jobs as PySpark DataFrame plans."""

__version__ = "0.1.0"
