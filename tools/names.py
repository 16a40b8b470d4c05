"""Names of the queries that a plan module registers."""
import re
import sys

print(" ".join(re.findall(r'^@plan\("(\w+)"', open(sys.argv[1]).read(), re.M)))
