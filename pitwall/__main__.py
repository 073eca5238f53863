"""python -m pitwall"""

import sys

from pitwall.cli import main

sys.exit(main())
