"""Denormalised documents from related tables, kept current by change notifications and searched, all on Spark."""
