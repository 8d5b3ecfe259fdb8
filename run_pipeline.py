"""spark-submit entry of the batch job."""

from goldseam.plans.pipeline import main

if __name__ == "__main__":
    raise SystemExit(main())
