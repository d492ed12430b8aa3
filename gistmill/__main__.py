import sys

from gistmill.cli import main

sys.exit(main())
