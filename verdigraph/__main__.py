import sys

from verdigraph.cli import main

sys.exit(main())
