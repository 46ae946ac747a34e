"""python -m relforge INPUT_FOLDER OUTPUT_FOLDER [textbook|compat]"""

import sys

from pyspark.sql import SparkSession

from relforge.plans import workflow


def main(args: list[str]) -> int:
    if not 2 <= len(args) <= 3:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("relforge").getOrCreate()
    state = workflow.run(spark, *args)
    print(workflow.summary(state))
    return int(state.status != "completed")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
