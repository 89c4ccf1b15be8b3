"""Subscriptions over the log and the indexes they feed."""
