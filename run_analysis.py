"""spark-submit target: checks, mart, reports and CSV extracts of one shop."""

from shopledger.plans.pipeline import main

main()
