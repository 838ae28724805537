import sys

from corvane.serving.cli import main

sys.exit(main())
