"""``python -m chronoweave <command> ...``"""

import sys

from .plans.experiments import main

sys.exit(main(sys.argv[1:]))
