"""All families together."""

from nightledger.catalog import features, models, monitoring, pricing, reports, streaming, text

QUERIES = {**features.QUERIES, **pricing.QUERIES, **models.QUERIES, **reports.QUERIES, **monitoring.QUERIES, **streaming.QUERIES, **text.QUERIES}
