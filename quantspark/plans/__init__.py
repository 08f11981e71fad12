"""Registered queries. Importing this package fills the registry."""

from quantspark.plans import boards, checks, factors, filings, landed, ledger, prices, research, streams, studies  # noqa: F401
from quantspark.plans.base import REGISTRY  # noqa: F401
